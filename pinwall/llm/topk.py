"""Exact top-k search by inner product over a pivot-distance index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinwall.llm import common

#: Pivots are picked among so many rows, those with the smallest hashes; every row is indexed.
SAMPLE, PIVOTS = 2048, 24
#: Rows in a leaf of the index, leaves searched by one task, queries in a block.
LEAF, LEAVES, QUERIES = 512, 32, 1024


def integers(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component as double; null unless all components are finite. Values beyond 64 bits saturate."""
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(scale)))
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)), whole)


def pick_pivots(sample: list[list[int]], count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Farthest-first pivots by dimension. Dimensions that aren't in the sample use the origin."""
    out: dict[int, np.ndarray] = {}
    for dim in sorted({len(v) for v in sample if len(v)}):
        x = np.array([v for v in sample if len(v) == dim], np.float64)
        chosen = [x[0]]
        near = np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < min(count, len(x)) and near.max() > 0:
            chosen.append(x[int(near.argmax())])
            near = np.minimum(near, np.linalg.norm(x - chosen[-1], axis=1))
        out[dim] = np.array(chosen)
    return out


def _pivots_of(pivots: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return pivots.get(dim, np.zeros((1, dim)))


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots (whose extra coordinate is 0) in the space with one more coordinate."""
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T + (extra * extra)[:, None]
    return np.sqrt(np.maximum(square, 0))


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows: in double precision while sums stay below 2^53, else in Python integers, clipped to 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """The narrowest integers that hold x, and their bytes."""
    top = int(max(x.max(initial=0), -x.min(initial=0)))
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


def _unpacked(kind: str, data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.int64).reshape(rows, dim)


def build_index(vectors: DataFrame, key: str = "id", vector: str = "v", asked: Column | None = None) -> tuple[DataFrame, dict[int, np.ndarray], float]:
    """(leaves, pivots, largest squared norm) of key (long), vector (array<long>, no nulls).

    Rows are keyed by their nearest pivot and the distance to it and sorted by that key over
    the whole table; a leaf is a run of at most LEAF rows of one dimension and pivot, with the
    least and greatest distance. Each vector gets one more coordinate, sqrt(M - |v|^2) with M
    the largest squared norm, so that the nearest vectors are those of the greatest products.
    Copies of one vector have one key and are dealt out by their ids. asked marks query rows.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.coalesce(asked if asked is not None else F.lit(False), F.lit(False)).alias("asked"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    top = rows.agg(F.max(square)).first()[0] or 0.0
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id", "v"), "id").limit(SAMPLE).select("v").collect()]
    pivots = pick_pivots(sample)

    @F.pandas_udf("dim int, pivot int, distance double")
    def place(v: pd.Series) -> pd.DataFrame:
        dims = v.map(len).to_numpy()
        pivot, dist = np.zeros(len(v), np.int32), np.zeros(len(v))
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            x = np.array([v.iloc[i] for i in at], np.float64).reshape(len(at), d)
            all_ = _distances(x, np.sqrt(np.maximum(top - (x * x).sum(1), 0)), _pivots_of(pivots, int(d)))
            pivot[at], dist[at] = all_.argmin(1), all_.min(1)
        return pd.DataFrame({"dim": dims.astype(np.int32), "pivot": pivot, "distance": dist})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select("id", "v", "asked", place("v").alias("p")).select("p.*", "id", "v", "asked")
    order = ["dim", "pivot", "distance", "id"]
    placed = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def leaves(batches):
        out = pa.schema([("leaf", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("nearest", pa.float64()), ("farthest", pa.float64()), ("kind", pa.string()), ("ids", pa.binary()), ("asked", pa.binary()), ("vectors", pa.binary())])
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            t = batch.to_pandas()
            if not len(t):
                continue
            run = ((t["dim"] != t["dim"].shift()) | (t["pivot"] != t["pivot"].shift())).cumsum()
            for (_, _), g in t.groupby([run, t.groupby(run).cumcount() // LEAF], sort=False):
                dim, pivot = int(g["dim"].iloc[0]), int(g["pivot"].iloc[0])
                kind, data = _packed(np.array(g["v"].tolist(), np.int64).reshape(len(g), dim))
                cols = [number, dim, pivot, g["distance"].min(), g["distance"].max(), kind, g["id"].to_numpy("<i8").tobytes(), g["asked"].to_numpy(np.uint8).tobytes(), data]
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cols, out)], schema=out)

    made = common.map_batches(placed, leaves, "leaf long, dim int, pivot int, nearest double, farthest double, kind string, ids binary, asked binary, vectors binary")
    return common.written(made), pivots, float(top)


class _Best:
    """The k best candidates of each query: greater scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def floor(self) -> np.ndarray:
        """The score that a candidate must reach to matter."""
        return np.array([r[-1][0] if len(r) == self.k else -np.inf for r in self.rows], np.float64)

    def add(self, which: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores: a row for each query of `which`, a column for each id; own: the queries' ids."""
        for i, line, me in zip(which, scores, own):
            fine = ids != me
            line, cand = line[fine], ids[fine]
            if len(line) > self.k:
                keep = line >= np.partition(line, -self.k)[-self.k]
                line, cand = line[keep], cand[keep]
            self.rows[i] = sorted(self.rows[i] + list(zip(line.tolist(), cand.tolist())), key=lambda r: (-r[0], r[1]))[: self.k]


def _first_scores(index: DataFrame, pivots: dict[int, np.ndarray], k: int) -> DataFrame:
    """id, dim, v, pivot, distance, near (distances to all pivots), floor: every query row and the k-th score within its own leaf (null for fewer rows)."""
    schema = "id long, dim int, kind string, v binary, pivot int, distance double, near array<double>, floor double"
    out = pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()), ("v", pa.binary()), ("pivot", pa.int32()), ("distance", pa.float64()), ("near", pa.list_(pa.float64())), ("floor", pa.float64())])

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, asked = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["asked"], np.uint8) > 0
                if not asked.any():
                    continue
                x = _unpacked(r["kind"], r["vectors"], len(ids), r["dim"])
                q = x[asked]
                near = _distances(q.astype(np.float64), np.zeros(len(q)), _pivots_of(pivots, r["dim"]))
                floors = []
                for me, line in zip(ids[asked], _inner(q, x)):
                    line = line[ids != me]
                    floors.append(float(np.partition(line, -k)[-k]) if len(line) >= k else None)
                kinds = [_packed(v) for v in q]
                cols = [ids[asked], [r["dim"]] * len(q), [a for a, _ in kinds], [b for _, b in kinds], near.argmin(1).astype(np.int32), near.min(1), near.tolist(), floors]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    found = common.map_batches(index.select("dim", "kind", "ids", "asked", "vectors"), run, schema)
    # equal rows are one query; the same vector has the same distances
    return found.groupBy("id", "dim", "kind", "v").agg(F.max("floor").alias("floor"), *(F.first(c).alias(c) for c in ("pivot", "distance", "near")))


def _query_blocks(queries: DataFrame) -> DataFrame:
    """block, dim, ids, vectors, floors, lo and hi (ranges of the distances to each pivot), least (floor), reach (largest squared norm): queries next to each other in the index's order."""
    n = max(1, -(-queries.count() // QUERIES))
    # queries without a score yet meet every leaf: they go into blocks of their own
    queries = queries.withColumn("open", F.col("floor").isNull())
    order = ["dim", "open", "pivot", "distance", "id"]
    schema = "block long, dim int, ids binary, vectors binary, floors binary, lo array<double>, hi array<double>, least double, reach double"
    out = pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("floors", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("least", pa.float64()), ("reach", pa.float64())])

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = batch.to_pylist()
            for dim, open_ in sorted({(r["dim"], r["open"]) for r in rows}):
                mine = [r for r in rows if (r["dim"], r["open"]) == (dim, open_)]
                for at in range(0, len(mine), QUERIES):
                    part = mine[at : at + QUERIES]
                    x = np.concatenate([_unpacked(r["kind"], r["v"], 1, dim) for r in part])
                    near = np.array([r["near"] for r in part])
                    floors = np.array([-np.inf if r["floor"] is None else r["floor"] for r in part])
                    ids = np.array([r["id"] for r in part], "<i8")
                    square = (x.astype(np.float64) ** 2).sum(1)
                    cols = [number, dim, ids.tobytes(), x.astype("<i8").tobytes(), floors.tobytes(), near.min(0).tolist(), near.max(0).tolist(), floors.min(), square.max(initial=0)]
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cols, out)], schema=out)

    return common.map_batches(queries.repartitionByRange(n, *order).sortWithinPartitions(*order), run, schema)


def _meetings(index: DataFrame, blocks: DataFrame, top: float) -> DataFrame:
    """block, leaf: pairs that the triangle inequality doesn't rule out; only bounds meet here, no vectors.

    |q - c| >= gap in the space with one more coordinate, where |q - c|^2 = |q|^2 + M - 2 q.c.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = index.select("leaf", "dim", "pivot", "nearest", "farthest", F.pmod(F.xxhash64("leaf"), F.lit(parts)).alias("part"))
    asked = blocks.select("block", "dim", "lo", "hi", "least", "reach").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    lo, hi = F.element_at("lo", F.col("pivot") + 1), F.element_at("hi", F.col("pivot") + 1)
    gap = F.greatest(F.col("nearest") - hi, lo - F.col("farthest"), F.lit(0.0))
    most = (F.col("reach") + F.lit(top) - gap * gap) / 2
    slack = F.lit(1e-6) * (F.col("reach") + F.lit(top + 1))
    return asked.join(bounds, ["part", "dim"]).where(most + F.abs(most) * 1e-9 + slack >= F.col("least")).select("block", "leaf")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "id", vector: str = "v") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of the greatest integer inner product with each query, ties to smaller ids.

    vectors: key (long), vector (array<long>). Rows whose key or vector is null take no part;
    vectors of other lengths than the query's aren't its candidates. A query's candidates are
    all rows with another key; equal query rows are one query, equal candidate rows count
    each. Fewer candidates than k give as many rows; an empty table gives none.

    Each query first gets the k-th score within its own leaf. Blocks of neighbouring queries
    then meet the leaves' bounds, and only pairs that the triangle inequality doesn't rule out
    get their vectors. A task has a block of queries and some leaves, nearest annuli first,
    and leaves out a query where no vector of a leaf can reach its k-th score so far. Blocks
    against blocks: nothing is broadcast, no pair of rows is shuffled.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    rows = common.written(rows)
    index, pivots, top = build_index(rows, asked=is_query)
    blocks = common.written(_query_blocks(common.written(_first_scores(index, pivots, k))))
    meetings = common.written(_meetings(index, blocks, top).join(index.select("leaf", (F.floor(F.col("leaf") / LEAVES)).alias("part")), "leaf"))
    left = blocks.join(meetings.select("block", "part").distinct(), "block").select("block", "part", "dim", "ids", "vectors", "floors").toDF("b", "p", "dim", "ids", "vectors", "floors")
    right = index.join(meetings, "leaf").select("block", "part", "dim", "pivot", "nearest", "farthest", "kind", "ids", "vectors")

    def search(_, mine: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, b in mine.iterrows():
            ids, dim = np.frombuffer(b["ids"], "<i8"), int(b["dim"])
            q = np.frombuffer(b["vectors"], "<i8").reshape(len(ids), dim)
            floors = np.frombuffer(b["floors"], np.float64)
            x = q.astype(np.float64)
            norm = (x * x).sum(1)
            to_pivots = _distances(x, np.zeros(len(x)), _pivots_of(pivots, dim))
            best = _Best(len(ids), k)
            gap = [np.maximum(np.maximum(lo - to_pivots[:, p], to_pivots[:, p] - hi), 0) for p, lo, hi in zip(leaves["pivot"], leaves["nearest"], leaves["farthest"])]
            for j in np.argsort([g.min() for g in gap], kind="stable"):
                reach = (norm + top - gap[j] ** 2) / 2
                active = np.flatnonzero(reach * (1 + 1e-9 * np.sign(reach)) + 1e-6 * (norm + top + 1) >= np.maximum(best.floor(), floors))
                if len(active):
                    cand = np.frombuffer(leaves["ids"].iloc[j], "<i8")
                    block = _unpacked(leaves["kind"].iloc[j], leaves["vectors"].iloc[j], len(cand), dim)
                    best.add(active, _inner(q[active], block), cand, ids[active])
            out += [(int(i), int(c), int(s)) for i, r in zip(ids, best.rows) for s, c in r]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    found = left.groupBy("b", "p").cogroup(right.groupBy("block", "part")).applyInPandas(search, "query_id long, vec_id long, score long")
    # queries of one key and different vectors are told apart by their scores only; keys are unique in a sound table
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_topk(spark, sf_dir):
    """The five best of `embeddings` for each row whose vec_id is divisible by 50."""
    rows = common.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), integers("embedding").alias("v"))
    return top_k(rows, F.col("id") % 50 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
