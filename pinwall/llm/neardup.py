"""MinHash near-dedup: a multi-index Hamming join of b-bit signatures finds candidates, full sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinwall.llm import common, graph

#: Shingles of so many words, and the least Jaccard similarity in hundredths.
WORDS, PERCENT = 5, 80
#: A signature is CHUNKS x 4 MinHash symbols of 16 bits, a chunk a 64-bit number.
CHUNKS, SYMBOLS = 7, 4
#: Candidates differ in at most so many symbols. With 2 * CHUNKS - 1 errors one chunk has at most one, so a key of three
#: of its four symbols is shared: no pair within the threshold is missed. Sets at similarity 0.8 are within it but for
#: one pair in 2,700, at 0.85 but for one in 70,000, at 0.9 but for one in 10 million.
THRESHOLD = 2 * CHUNKS - 1
#: Centres for each key in the two star rounds.
CENTRES, STAR_ROUNDS = 4, 2
#: Exact round: distances to a hub's centre are told apart in steps of 1 / STEPS; bytes of sets in a block of strays and of others; what a set counts as at least.
STEPS, STRAY_BYTES, OTHER_BYTES, LEAST_BYTES = 20, 1 << 18, 1 << 19, 1 << 8

_SIG = [f"s{i}" for i in range(CHUNKS)]
_MULTIPLIERS = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, CHUNKS * SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text, whose A-Z are lower-cased, the sorted distinct hashes of its n-word shingles; with fewer words, that of the whole sequence; without words, none."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    none = np.zeros(0, np.uint64)
    out = [none] * len(data)

    def shingles(words: common.Words) -> Iterator[np.ndarray]:
        runs = words.hashes()
        fixed = runs.fixed(n) if len(words) >= n else none
        for b, e in zip(words.begin.tolist(), words.begin[1:].tolist()):
            if e - b >= n:
                x = np.sort(fixed[b : e - n + 1])
                yield x[np.append(True, x[1:] != x[:-1])]
            else:
                yield runs.spans(np.array([b]), np.array([e])) if e > b else none

    for words in common.word_blocks(((i, d) for i, d in enumerate(data) if len(d) <= common.STEP), n - 1):
        for (i, _), x in zip(words.tags, shingles(words)):
            out[i] = x
    for i, d in enumerate(data):
        if len(d) > common.STEP:
            parts = [x for words in common.stretches(i, d, n - 1) for x in shingles(words)]
            out[i] = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
    return out


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, CHUNKS) signed 64-bit numbers of sets that aren't empty: 16 bits of the least hash under each of the multipliers."""
    if not sets:
        return np.zeros((0, CHUNKS), np.int64)
    begin = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    least = np.stack([np.minimum.reduceat(flat * m, begin) for m in _MULTIPLIERS], axis=1)
    least ^= least >> np.uint64(17)
    symbols = (least & np.uint64(0xFFFF)).reshape(len(sets), CHUNKS, SYMBOLS)
    return (symbols << np.array([0, 16, 32, 48], np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signatures(docs: DataFrame, words: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, rk (row key), n_shingles, c (128 bits of the whole set; null if empty), s0...: one row for each row of docs."""

    def make():
        def each(cols):
            sets = shingle_sets(cols["text"], words)
            some = [i for i, x in enumerate(sets) if len(x)]
            out = {"doc_id": cols["doc_id"], "rk": cols["rk"], "n_shingles": list(map(len, sets))}
            out["c"] = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            sig = np.zeros((len(sets), CHUNKS), np.int64)
            sig[some] = signatures_of([sets[i] for i in some])
            empty = np.ones(len(sets), bool)
            empty[some] = False
            return out | {name: pa.array(sig[:, i], mask=empty) for i, name in enumerate(_SIG)}

        return each

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), common.row_key(key, text).alias("rk"), F.col(text).cast("string").alias("text"))
    kind = {"rk": ("binary", pa.binary()), "c": ("binary", pa.binary())}
    schema = [(n, *kind.get(n, ("long", pa.int64()))) for n in ["doc_id", "rk", "n_shingles", "c", *_SIG]]
    return common.over_rows(rows, ", ".join(f"{n} {k}" for n, k, _ in schema), pa.schema([(n, t) for n, _, t in schema]), make, rows=256)


def _sets(docs: DataFrame, wanted: DataFrame, words: int, text: str, key: str) -> DataFrame:
    """node, tokens (sorted 64-bit hashes as bytes) for wanted (rk, node).

    A pass over the texts makes the sets of the rows that a filter of fixed size lets through;
    whole texts aren't shuffled.
    """
    bits = docs.sparkSession.sparkContext.broadcast(common.filter_bits(wanted.select(F.xxhash64("rk").alias("h"))))
    rows = docs.select(common.row_key(key, text).alias("rk"), F.col(text).cast("string").alias("text")).select("rk", F.xxhash64("rk").alias("h"), "text")
    schema = pa.schema([("rk", pa.binary()), ("tokens", pa.binary())])

    def run(batches):
        for batch in batches:
            at = np.flatnonzero(common.passes(bits.value, batch.column(1).to_numpy().view(np.uint64)))
            for i in range(0, len(at), 256):
                part = batch.take(pa.array(at[i : i + 256]))
                sets = shingle_sets(part.column(2).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], schema=schema)

    made = common.map_batches(rows, run, "rk binary, tokens binary").join(wanted.hint("merge"), "rk").select("node", "tokens")
    # equal rows share a row key; one of them is enough
    return made.dropDuplicates(["node"])


def index_keys(sig: DataFrame) -> DataFrame:
    """key, node: for every chunk one key for each symbol that may be wrong."""
    lane = (1 << 16) - 1
    keys = []
    for i, s in enumerate(_SIG):
        for j in range(SYMBOLS):
            mask = _signed(((1 << 64) - 1) ^ (lane << (16 * j)))
            keys.append(F.xxhash64(F.lit(i * SYMBOLS + j), F.col(s).bitwiseAND(F.lit(mask))))
    return sig.select(F.explode(F.array(*keys)).alias("key"), "node")


def symbol_distance(a: str, b: str) -> Column:
    """In how many 16-bit symbols the signatures with these column prefixes differ."""
    low = F.lit(0x0000FFFF0000FFFF)
    total = F.lit(0)
    for s in _SIG:
        x = F.col(a + s).bitwiseXOR(F.col(b + s))
        for half in (x, F.shiftrightunsigned(x, 16)):
            # two symbols with 16 free bits above each: one that isn't 0 carries into bit 16
            total = total + F.bit_count((half.bitwiseAND(low) + low).bitwiseAND(F.lit(0x0001000000010000)))
    return total


def near(a: str, b: str, percent: int) -> Column:
    """Within the signature threshold, and of sizes that allow the similarity."""
    low, high = F.least(F.col(a + "n"), F.col(b + "n")), F.greatest(F.col(a + "n"), F.col(b + "n"))
    return (low * 100 >= high * percent) & (symbol_distance(a, b) <= THRESHOLD)


def _named(sig: DataFrame, prefix: str) -> DataFrame:
    return sig.select(*(F.col(x).alias(prefix + x) for x in ("node", "n", *_SIG)))


def _common(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose full sets are similar enough."""
    left, right = sets.select(F.col("node").alias("u"), F.col("tokens").alias("tu")), sets.select(F.col("node").alias("v"), F.col("tokens").alias("tv"))

    def make():
        def each(cols):
            keep = []
            for i, (a, b) in enumerate(zip(cols["tu"], cols["tv"])):
                both = _common(a, b)
                if 100 * both >= percent * ((len(a) + len(b)) // 8 - both):
                    keep.append(i)
            return {"u": [cols["u"][i] for i in keep], "v": [cols["v"][i] for i in keep]}

        return each

    rows = pairs.join(left, "u").join(right, "v").select("u", "v", "tu", "tv")
    return common.over_rows(rows, "u long, v long", pa.schema([("u", pa.int64()), ("v", pa.int64())]), make)


def _star(keep: DataFrame, sig: DataFrame, sets: DataFrame, seed: int, percent: int) -> DataFrame:
    """Confirmed links (u, v) of each node of keep (key, node, root) to the nearest centre of its keys that isn't in its component yet."""
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(seed + i)).alias("h"), "node", "root")).alias(f"m{i}") for i in range(CENTRES)]
    centres = keep.groupBy("key").agg(*picks).select("key", F.explode(F.array_distinct(F.array(*(F.struct(F.col(f"m{i}.node").alias("centre"), F.col(f"m{i}.root").alias("its")) for i in range(CENTRES))))).alias("x"))
    centres = common.written(centres.select("key", "x.centre", "x.its"))
    pairs = keep.join(centres, "key").where("root <> its").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct()
    seen = pairs.join(_named(sig, "u_"), F.col("u") == F.col("u_node")).join(_named(sig, "v_"), F.col("v") == F.col("v_node")).where(near("u_", "v_", percent))
    best = seen.groupBy("u").agg(F.min(F.struct(symbol_distance("u_", "v_").alias("d"), F.xxhash64("v", F.lit(seed)).alias("h"), "v")).alias("best"))
    best = common.written(best.select("u", F.col("best.v").alias("v")))
    found = common.written(_confirmed(best, sets, percent))
    common.discard(centres, best)
    return found


def _mixed(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, root: rows of keys that more than one component shares."""
    rooted = shared.join(labels, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return common.written(rooted.join(common.written(keys), "key"))


def _similar_blocks(strays: list[bytes], others: list[bytes], percent: int, width: int = 4096) -> np.ndarray:
    """Whether each stray is similar to each other set: exact intersections by products of 0/1 matrices over the tokens that two sets share, some columns at a time."""
    x = [np.frombuffer(t, np.uint64) for t in strays]
    y = [np.frombuffer(t, np.uint64) for t in others]
    n, m = np.array([len(a) for a in x]), np.array([len(a) for a in y])
    if len(x) * len(y) <= 64:
        both = np.array([[_common(a, b) for b in others] for a in strays], np.int64).reshape(len(x), len(y))
    else:
        _, left = np.unique(np.concatenate(x + y), return_inverse=True)
        cols, counts = left, np.bincount(left)
        rank = np.cumsum(counts > 1) - 1
        row = np.repeat(np.arange(len(x) + len(y)), np.concatenate([n, m]))
        fine = counts[cols] > 1
        row, cols = row[fine], rank[cols[fine]]
        both = np.zeros((len(x), len(y)), np.int64)
        order = np.argsort(cols, kind="stable")
        row, cols = row[order], cols[order]
        for at in range(0, int(cols[-1]) + 1 if len(cols) else 0, width):
            lo, hi = np.searchsorted(cols, [at, at + width])
            block = np.zeros((len(x) + len(y), width), np.float32)
            block[row[lo:hi], cols[lo:hi] - at] = 1
            both += (block[: len(x)] @ block[len(x) :].T).astype(np.int64)
    return 100 * both >= percent * (n[:, None] + m[None, :] - both)


def _block_links(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (unit..., side, root, tokens) sorted by unit: links of each unit's strays, one for each component that a stray meets."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    unit, strays, others = None, [], []

    def links():
        if not strays or not others:
            return []
        yes = _similar_blocks([t for _, t in strays], [t for _, t in others], percent)
        out = set()
        for i, (root, _) in enumerate(strays):
            out |= {(root, others[j][0]) for j in np.flatnonzero(yes[i])}
        return sorted(x for x in out if x[0] != x[1])

    def emit():
        got = links()
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], pa.int64())], schema=schema)

    for batch in batches:
        for *key, side, root, tokens in zip(*(c.to_pylist() for c in batch.columns)):
            if key != unit:
                if unit is not None:
                    yield emit()
                unit, strays, others = key, [], []
            (others if side else strays).append((root, tokens))
    if unit is not None:
        yield emit()


def _centred(mixed: DataFrame, sig: DataFrame, links: DataFrame) -> DataFrame:
    """hub, centre, node, root, near: of each key's rows those that may be linked across components.

    A key's hub is the component that most of its rows belong to, its centre the hub's node
    with the most links there. Symbols differ in a metric: a row of another component (a
    stray) can only be within THRESHOLD of one of the hub's rows if it is within THRESHOLD and
    the hub's radius of the centre. Two strays must be within THRESHOLD of each other.
    """
    sizes = mixed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    hubs = sizes.groupBy("key").agg(F.max(F.struct("k", "root")).alias("top")).select("key", F.col("top.root").alias("hub"))
    full = common.written(mixed.join(common.written(hubs), "key"))
    rows = full.select("hub", "node", "root").distinct()
    degrees = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    members = rows.where("root = hub").join(degrees, "node", "left")
    centres = common.written(members.groupBy("hub").agg(F.max(F.struct(F.coalesce("k", F.lit(0)).alias("k"), "node")).alias("top")).select("hub", F.col("top.node").alias("centre")))
    at = rows.join(centres, "hub").join(_named(sig, "a_"), F.col("node") == F.col("a_node")).join(_named(sig, "z_"), F.col("centre") == F.col("z_node"))
    at = common.written(at.select("hub", "centre", "node", "root", symbol_distance("a_", "z_").alias("off")))
    radius = at.where("root = hub").groupBy("hub").agg(F.max("off").alias("radius"))
    near_hub = at.where("root <> hub").join(radius, "hub").where(F.col("off") <= THRESHOLD + F.col("radius")).select("hub", "node")
    loose = full.where("root <> hub")
    several = loose.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    loose = loose.join(several, "key", "left_semi").join(_named(sig, "a_"), F.col("node") == F.col("a_node"))
    other = loose.select("key", "root", *(F.col("a_" + x) for x in ("node", "n", *_SIG))).toDF("b_key", "b_root", *("b_" + x for x in ("node", "n", *_SIG)))
    admitted = (F.col("key") == F.col("b_key")) & (F.col("root") != F.col("b_root")) & near("a_", "b_", percent=0)
    near_stray = loose.join(other, admitted, "left_semi").select("hub", "node")
    strays = near_hub.withColumn("by_hub", F.lit(1)).unionByName(near_stray.withColumn("by_hub", F.lit(0))).groupBy("hub", "node").agg(F.max("by_hub").alias("by_hub"))
    strays = common.written(strays)
    wanted = at.where("root = hub").join(strays.where("by_hub = 1").select("hub").distinct(), "hub", "left_semi").select("hub", "centre", "node", "root")
    kept = at.join(strays.select("hub", "node"), ["hub", "node"], "left_semi").select("hub", "centre", "node", "root").unionByName(wanted)
    kept = common.written(kept)
    common.discard(full, centres, at, strays)
    return kept


def _exact(mixed: DataFrame, sig: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links (u, v between roots) that the star rounds have left: all candidates across components, on full sets.

    The Jaccard distance is a metric too. Strays and members of a hub are put into steps of
    their exact distance to the hub's centre; sets whose steps are further apart than the
    linking distance can't be linked and never meet. What is left meets block against block. A
    block holds a bounded number of bytes of sets: those of neighbouring steps as long as they
    fit, or a share of one step; a set is copied for each block that it meets, not for each step.
    """
    rows = _centred(mixed, sig, links)
    mine = sets.select("node", "tokens")
    its = sets.select(F.col("node").alias("centre"), F.col("tokens").alias("its"))

    def make():
        def each(cols):
            step, linked, size = [], [], []
            for a, b in zip(cols["tokens"], cols["its"]):
                both = _common(a, b)
                total = (len(a) + len(b)) // 8 - both
                step.append(STEPS - both * STEPS // total)
                linked.append(100 * both >= percent * total)
                size.append(max(len(a), LEAST_BYTES))
            return {n: cols[n] for n in ("hub", "node", "root")} | {"step": step, "linked": linked, "size": size}

        return each

    out = pa.schema([("hub", pa.int64()), ("node", pa.int64()), ("root", pa.int64()), ("step", pa.int32()), ("linked", pa.bool_()), ("size", pa.int64())])
    placed = rows.join(mine, "node").join(its, "centre").select("hub", "node", "root", "tokens", "its")
    placed = common.written(common.over_rows(placed, "hub long, node long, root long, step int, linked boolean, size long", out, make, rows=128))
    direct = placed.where("linked and root <> hub").select(F.col("root").alias("u"), F.col("hub").alias("v"))
    # a component that the centre links is the hub's own from here on
    joined = direct.select(F.col("u").alias("root"), F.col("v").alias("hub")).distinct()
    strays = common.written(placed.where("root <> hub").join(joined, ["hub", "root"], "left_anti"))
    reach = (100 - percent) * STEPS // 100 + 1

    def plan(rows: DataFrame, side: str, size: int) -> DataFrame:
        """hub, the first and last step of each stretch of steps, its steps, and in how many blocks it is cut."""
        steps = rows.groupBy("hub", "step").agg(F.sum("size").alias("bytes"))
        below = F.sum("bytes").over(Window.partitionBy("hub").orderBy("step")) - F.col("bytes")
        stretches = steps.withColumn("at", F.floor(below / size)).groupBy("hub", "at")
        first, last, blocks = F.min("step"), F.max("step"), F.ceil(F.sum("bytes") / size).cast("int")
        return stretches.agg(first.alias(side), last.alias(side + "_last"), F.collect_list("step").alias(side + "_steps"), blocks.alias("n" + side)).drop("at")

    apart = F.greatest(F.col("s") - F.col("o_last"), F.col("o") - F.col("s_last"))
    pairs = plan(strays, "s", STRAY_BYTES).join(plan(placed, "o", OTHER_BYTES), "hub").where(apart <= reach)
    pairs = common.written(pairs)

    def dealt(rows: DataFrame, steps: str, block: str, n_own: str, their_block: str, n_theirs: str, side: int) -> DataFrame:
        met = pairs.select("hub", F.explode(steps).alias("step"), "s", "ns", "o", "no")
        out = rows.join(met, ["hub", "step"]).withColumn(block, F.pmod(F.xxhash64("node"), F.col(n_own)).cast("int"))
        out = out.withColumn(their_block, F.explode(F.sequence(F.lit(0), F.col(n_theirs) - 1)))
        return out.select("node", "hub", "s", "sb", "o", "ob", F.lit(side).alias("side"), "root")

    cards = dealt(strays, "s_steps", "sb", "ns", "ob", "no", 0).unionByName(dealt(placed, "o_steps", "ob", "no", "sb", "ns", 1))
    unit = ["hub", "s", "sb", "o", "ob"]
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    units = cards.join(mine, "node").select(*unit, "side", "root", "tokens").repartition(n, *unit).sortWithinPartitions(*unit, "side")
    found = common.map_batches(units, lambda batches: _block_links(batches, percent), "u long, v long")
    return common.written(found.unionByName(direct))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, rk, n_shingles, component_id, kept, group: one row for each row of docs.

    Documents are linked if the Jaccard similarity of their sets of `words`-word shingles is at
    least percent / 100. component_id is the smallest doc_id of all that are reachable over
    links, kept tells whether that is the document's own. Texts without words, null texts and
    null ids are linked with nothing (a null id keeps a null component and is kept). Rows of
    equal sets are one node of the graph; rows that share a doc_id each get their own result.
    group tells components apart also where they share their smallest doc_id; it is null for
    rows that are linked with nothing for want of words or an id.

    Candidates share an index key (all pairs within THRESHOLD symbols do). Two rounds link each
    node to its nearest of a few centres of its keys, which joins nearly all of a group of
    copies without listing its pairs; what candidates remain across components are compared
    exactly, by distance to their hub's centre and block against block (_exact). No group
    meets in one task at any step.
    """
    base = common.written(signatures(docs, words, text, key))
    own = base.where(F.col("c").isNotNull() & F.col("doc_id").isNotNull())
    nodes = own.groupBy("c").agg(F.min("doc_id").alias("doc"), F.min("rk").alias("rk"), F.first("n_shingles").alias("n"), *(F.first(s).alias(s) for s in _SIG))
    nodes = common.written(nodes.withColumn("node", F.monotonically_increasing_id()))
    keys = index_keys(nodes)
    often = common.written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key"))
    shared = common.written(keys.join(often, "key"))
    sig = common.written(nodes.join(shared.select("node").distinct(), "node", "left_semi"))
    sets = common.written(_sets(docs, sig.select("rk", "node"), words, text, key))
    sig = sig.select("node", "n", *_SIG)
    links, labels, mixed = None, None, shared.withColumn("root", F.col("node"))
    for i in range(STAR_ROUNDS):
        found = _star(mixed, sig, sets, i * CENTRES, percent)
        links = found if links is None else links.unionByName(found)
        labels = graph.components(links)
        mixed = _mixed(shared, labels)
        if mixed.isEmpty():
            break
    else:
        labels = graph.components(links.unionByName(_exact(mixed, sig, sets, links, percent)))
    docs_of = labels.join(nodes.select("node", "doc"), "node")
    least = common.written(docs_of.groupBy("root").agg(F.min("doc").alias("least")))
    mine = docs_of.join(least, "root").select("node", "least", "root")
    final = nodes.select("c", "node", "doc").join(mine, "node", "left").select("c", F.coalesce("least", "doc").alias("least"), F.coalesce("root", "node").alias("group"))
    out = base.select("doc_id", "rk", "n_shingles", "c").join(common.written(final), "c", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "rk", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group"))


def op4_minhash_neardup(spark, sf_dir):
    """Components of `documents` under three-word shingles and a similarity of 0.85."""
    found = near_duplicates(common.table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END)) AS h FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT u, v FROM p JOIN n x ON p.u = x.doc_id JOIN n y ON p.v = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, min(other) = r.doc_id AS kept
FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""
