"""Best-fit packing of token pieces by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.llm import common, tokens

CAPACITY = 2048
#: Pieces that one island packs; islands for each such block; epochs, with a migration between two; children of an epoch.
BLOCK, ISLANDS, EPOCHS, CHILDREN = 2000, 2, 2, 10
POPULATION = 4
#: Odd islands begin with items in falling order of their lengths times a random number this close to 1; even ones in random order.
BLUR = 0.3
#: A level keeps bins with at most so much room; the pieces of the others go on to the next level, mixed anew.
ROOM = (0, 1, 2, 4, 8, 16, 32, 64)


# ---------------------------------------------------------------- pieces


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, item (and ids, little-endian uint32): the token pieces of every whole document.

    A document is its ids and end_id; null texts are empty. Longer ones are cut into pieces of
    `capacity`, of which the last may be shorter. item numbers the pieces of the table.
    """
    path = tokenizer_path or tokens.default_path()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "item"] + ["ids"] * with_ids

    def run(batches):
        enc = tokens.encoder(path)
        item = TaskContext.get().partitionId() << 33
        out = pa.schema([(n, pa.int64() if n != "ids" else pa.binary()) for n in names])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for k, ids in zip(part.column(0).to_pylist(), enc.many(part.column(1).to_pylist())):
                    ids += end
                    for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[start : start + 4 * capacity]
                        rows.append((k, n, start // 4, len(piece) // 4, zlib.crc32(piece), item) + (piece,) * with_ids)
                        item += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return common.map_batches(rows, run, ", ".join(f"{n} {'long' if n != 'ids' else 'binary'}" for n in names))


# ---------------------------------------------------------------- genetic algorithm


class Packing:
    """A chromosome: bins as lists of item positions, with their fills."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def fitness(self) -> tuple[int, int]:
        """Fewer bins are better; among equals, few bins with much room are better than many with some."""
        return len(self.bins), -sum(f * f for f in self.fills)


def best_fit(order: list[int], lengths: list[int], capacity: int, into: Packing | None = None) -> Packing:
    """Puts items in this order into the bin that they leave the least room in, or a new one.

    Open bins are listed by their room; a bit mask of the rooms that occur gives the least one
    that takes a length.
    """
    bins, fills = ([list(b) for b in into.bins], list(into.fills)) if into else ([], [])
    open_: list[list[int] | None] = [None] * (capacity + 1)
    rooms = 0
    for i, f in enumerate(fills):
        if room := capacity - f:
            open_[room] = [*(open_[room] or ()), i]
            rooms |= 1 << room
    for item in order:
        size = lengths[item]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            i = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
            bins[i].append(item)
            fills[i] += size
            room -= size
        else:
            i, room = len(bins), capacity - size
            bins.append([item])
            fills.append(size)
        if room:
            if open_[room]:
                open_[room].append(i)
            else:
                open_[room] = [i]
                rooms |= 1 << room
    return Packing(bins, fills)


def crossover(one: Packing, two: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Injects whole well-filled bins of `two` into `one`; bins of `one` that hold injected items dissolve, what they displaced is best-fitted."""
    full = sorted(range(len(two.bins)), key=lambda i: (-two.fills[i], i))
    injected = full[: rng.randint(1, max(1, 3 * len(full) // 4))]
    owned = bytearray(len(lengths))
    for i in injected:
        for item in two.bins[i]:
            owned[item] = 1
    bins, fills = [two.bins[i] for i in injected], [two.fills[i] for i in injected]
    displaced = []
    for b, f in zip(one.bins, one.fills):
        free = [item for item in b if not owned[item]]
        if len(free) == len(b):
            bins.append(b)
            fills.append(f)
        else:
            displaced += free
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(displaced, lengths, capacity, Packing(bins, fills))


def mutate(one: Packing, lengths: list[int], capacity: int, rng: random.Random) -> Packing:
    """Dissolves the emptiest bin, some of those with room and a few others, and best-fits their items."""
    roomy = [i for i, f in enumerate(one.fills) if f < capacity]
    rng.shuffle(roomy)
    out = set(roomy[: max(2, int(len(roomy) * rng.uniform(0.05, 1.0)))]) | {min(range(len(one.bins)), key=one.fills.__getitem__)}
    out |= set(rng.sample(range(len(one.bins)), max(1, len(one.bins) // 50)))
    loose = sorted((item for i in out for item in one.bins[i]), key=lambda i: (-lengths[i], i))
    rest = [i for i in range(len(one.bins)) if i not in out]
    return best_fit(loose, lengths, capacity, Packing([one.bins[i] for i in rest], [one.fills[i] for i in rest]))


def evolve(lengths: list[int], capacity: int, seed: int, elites: list[Packing] = (), children: int = CHILDREN, population: int = POPULATION, blur: float | None = None) -> tuple[Packing, int]:
    """(the best packing of one island's epoch, the number of crossovers); elites (its own and a migrant) join the first population.

    The others begin as best fits of random orders, or of blurred falling ones. It ends early
    at the least possible number of bins.
    """
    rng = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    pool = list(elites)
    while len(pool) < population:
        order = list(range(len(lengths)))
        if blur is None:
            rng.shuffle(order)
        else:
            key = [n * rng.uniform(1 - blur, 1 + blur) for n in lengths]
            order.sort(key=key.__getitem__, reverse=True)
        pool.append(best_fit(order, lengths, capacity))
    ranked = sorted(((p.fitness(), i) for i, p in enumerate(pool)))
    pool, marks = [pool[i] for _, i in ranked], [f for f, _ in ranked]
    crossed = 0
    while crossed < children and marks[0][0] > least:
        one, two = rng.sample(pool, 2) if len(pool) > 1 else (pool[0], pool[0])
        child = mutate(crossover(one, two, lengths, capacity, rng), lengths, capacity, rng)
        crossed += 1
        mark = child.fitness()
        if mark not in marks and mark < marks[-1]:
            at = bisect_left(marks, mark)
            pool.insert(at, child)
            marks.insert(at, mark)
            del pool[population:], marks[population:]
    return pool[0], crossed


_ISLAND = "block long, island int, items array<long>, lengths array<int>, bin array<int>, bins int, rank long, crossed int"


def _islands(rows: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """One epoch of each row's island (block, island, items, lengths, elites: array of bin numbers by item): a task holds one island at a time."""
    out = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("items", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("bin", pa.list_(pa.int32())), ("bins", pa.int32()), ("rank", pa.int64()), ("crossed", pa.int32())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, island, items, lengths, elites = (c[i].as_py() for c in batch.columns)
                order = sorted(range(len(items)), key=items.__getitem__) if not elites else range(len(items))
                items, lengths = [items[j] for j in order], [lengths[j] for j in order]
                pool = []
                for bins in elites or ():
                    groups: list[list[int]] = [[] for _ in range(max(bins) + 1)]
                    for item, b in enumerate(bins):
                        groups[b].append(item)
                    pool.append(Packing(groups, [sum(map(lengths.__getitem__, g)) for g in groups]))
                best, crossed = evolve(lengths, capacity, (block * 1_000_003 + island) * 31 + epoch, pool, blur=BLUR if island % 2 else None)
                bins = [0] * len(items)
                for n, members in enumerate(best.bins):
                    for item in members:
                        bins[item] = n
                cols = [block, island, items, lengths, bins, len(best.bins), best.fitness()[1], crossed]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cols, out)], schema=out)

    return common.map_batches(rows, run, _ISLAND)


def _level(items: DataFrame, n_blocks: int, level: int, capacity: int) -> DataFrame:
    """block, bins, crossed, and items, lengths, bin (arrays): the best island's packing of each block."""
    spark = items.sparkSession
    block = F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_blocks))
    packed = items.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item", F.col("length").cast("int").alias("length"))).alias("x"))
    rows = packed.select("block", F.explode(F.array(*(F.lit(i) for i in range(ISLANDS)))).alias("island"), F.col("x.item").alias("items"), F.col("x.length").alias("lengths"))
    rows = rows.withColumn("elites", F.lit(None).cast("array<array<int>>"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for epoch in range(EPOCHS):
        spread = rows.select("block", "island", "items", "lengths", "elites").repartition(min(parts, n_blocks * ISLANDS), "block", "island")
        made = common.written(_islands(spread, capacity, epoch))
        # the elite stays and also moves to the next island of the ring
        migrant = made.select("block", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("bin").alias("migrant"))
        rows = made.join(migrant, ["block", "island"]).withColumn("elites", F.array("bin", "migrant"))
    best = F.min_by(F.struct("items", "lengths", "bin"), F.struct("bins", "rank", "island"))
    return made.groupBy("block").agg(best.alias("best"), F.min("bins").alias("bins"), F.sum("crossed").alias("crossed")).select("block", "bins", "crossed", "best.*")


def _placed(made: DataFrame) -> DataFrame:
    """block, item, length, bin, offset, fill: a row for each item."""
    out = pa.schema([("block", pa.int64()), ("item", pa.int64()), ("length", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("fill", pa.int64())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block, items, lengths, bins = (batch.column(n)[i] for n in range(4))
                items, lengths, bins = (np.asarray(c.values, np.int64) for c in (items, lengths, bins))
                order = np.argsort(bins, kind="stable")
                fill = np.bincount(bins, weights=lengths).astype(np.int64)
                upto = np.cumsum(lengths[order]) - lengths[order]
                first = np.cumsum(fill) - fill
                cols = [np.full(len(items), block.as_py()), items[order], lengths[order], bins[order], upto - first[bins[order]], fill[bins[order]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return common.map_batches(made.select("block", "items", "lengths", "bin"), run, "block long, item long, length long, bin long, offset long, fill long")


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """item, sequence_id, offset of item (long, unique), length (long, 1 to capacity): sequences of at most `capacity`, filled from offset 0 without gaps.

    Items of full length are sequences of their own. The others are dealt into blocks of about
    BLOCK items by hash, whatever their source or length. Each block is one row of arrays,
    evolved by ISLANDS islands whose elites migrate between epochs. Full bins stay;
    the items of the others are dealt into fewer blocks and packed again, with growing
    tolerance, until one block is left. So room remains in the last block's bins and, at most
    the tolerance, in others; the number of rounds grows with the logarithm of the items.
    """
    spark = items.sparkSession
    whole = items.where(F.col("length") >= capacity).select("item", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = items.where(F.col("length") < capacity).select("item", "length")
    done = [whole]
    n, level = rest.count(), 0
    while n:
        blocks = max(1, round(n / BLOCK))
        made = common.written(_placed(_level(rest, blocks, level, capacity)))
        # one number for (level, block, bin): up to 2^6 levels, 2^36 blocks, 2^20 bins
        numbered = F.lit(level << 56) + F.col("block") * F.lit(1 << 20) + F.col("bin")
        if blocks == 1:
            done.append(made.select("item", numbered.alias("sequence_id"), "offset"))
            break
        kept = F.col("fill") >= capacity - ROOM[min(level, len(ROOM) - 1)]
        done.append(made.where(kept).select("item", numbered.alias("sequence_id"), "offset"))
        rest = made.where(~kept).select("item", "length")
        left = rest.count()
        if left > 0.9 * n and level >= len(ROOM):
            done[-1] = made.select("item", numbered.alias("sequence_id"), "offset")
            break
        n, level = left, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece; repeated documents are packed each."""
    made = common.written(pieces(docs, tokenizer_path, capacity, text=text, key=key))
    return made.withColumn("piece", F.col("piece").cast("int")).join(pack(made.select("item", "length"), capacity), "item").drop("item")


def sequences(with_ids: DataFrame, packing: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from pieces(..., with_ids=True) and pack()'s rows; a group is one sequence."""
    rows = with_ids.join(packing, "item").groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))


def op10_packing(spark, sf_dir):
    """All `documents` packed into sequences of 2048 tokens."""
    return pack_documents(common.table(spark, sf_dir, "documents"))
