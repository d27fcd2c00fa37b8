"""Mixing sources to target weights by Efraimidis-Spirakis keys; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinwall.llm import common

#: Weights of the sources in code point order, repeated.
WEIGHTS = (5, 2, 1)
#: The mix holds so many times the corpus' words, and a source at most so many times its own.
RATIO, EPOCHS = 1.5, 2
#: Characters that lower a document's quality weight.
SYMBOLS = "0123456789#$%&*+/<=>@\\^_`{|}~"
#: Sampling keys have places of PLACE_BITS bits; places are looked at DIGIT_BITS at a time until the range of a source
#: in which its budget ends holds at most RANGE_ROWS documents, which are sorted.
PLACE_BITS, DIGIT_BITS, RANGE_ROWS = 48, 12, 4096
#: Up to so many sources (a row of seven numbers each), their parameters are broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD_REGEX)), F.lit(0)).cast("long")


def quality_weight(text: str) -> Column:
    """0.25 to 1: the squared share of characters that are neither digits nor symbols; null and empty texts weigh 1."""
    n = F.greatest(F.length(F.col(text)), F.lit(1))
    bad = F.length(F.col(text)) - F.length(F.translate(F.col(text), SYMBOLS, ""))
    share = F.lit(1.0) - F.coalesce(bad, F.lit(0)) / n
    return F.greatest(share * share, F.lit(0.25))


def sampling_key(digest: Column, weight: Column) -> Column:
    """-ln(u) / weight, u from the first 48 bits of a row key: small keys are drawn first, and reruns draw the same."""
    u = (F.conv(F.substring(F.hex(digest), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))
    return -F.log(u) / weight


def scored(docs: DataFrame, keep: Column, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """kept (what the caller wants to keep of a row), source, size, weight, rk, skey: one narrow pass over the texts, for common.written."""
    rows = docs.select(
        keep.alias("kept"),
        F.col(source).cast("string").alias("source"),
        word_count(text).alias("size"),
        quality_weight(text).alias("weight"),
        common.row_key(key, text).alias("rk"),
    )
    return rows.withColumn("skey", sampling_key(F.col("rk"), F.col("weight"))).drop("weight")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, n, target from source, source_size, n (a row for each source).

    Sources share ratio * all words by weight. With sources in order of cap / weight, level
    is what a unit of weight gets once the sources before are at their caps; the first source
    whose cap isn't below its level fixes the level for all. Both windows see a row a source.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), F.col("rank") % len(weights) + 1)
    capped = ranked.select("source", "source_size", "n", "rank", w.alias("w"), (F.col("source_size") * epochs).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    rest = F.sum("source_size").over(all_) * F.lit(float(ratio)) - F.coalesce(F.sum("cap").over(before), zero)
    level = rest / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), zero))
    levels = capped.withColumn("level", level).withColumn("at", F.row_number().over(order))
    fixed = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("at", "level"))
    final = F.min(fixed).over(all_)["level"]
    return levels.withColumn("final", final).select(
        "source",
        "source_size",
        "n",
        F.when(F.col("final").isNull() | (F.col("cap") / F.col("w") <= F.col("final")), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("final")).alias("target"),
    )


def _with(rows: DataFrame, params: DataFrame, small: bool, on: list[str]) -> DataFrame:
    """Null-safe join on source (and more); a source with most rows is split by Spark where the parameters are too many to broadcast."""
    params = params.select(*(F.col(c).alias(f"p_{c}") if c in on else F.col(c) for c in params.columns))
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    return rows.join(F.broadcast(params) if small else params, match).drop(*(f"p_{c}" for c in on))


def _crossing_ranges(keys: DataFrame, params: DataFrame, small: bool) -> tuple[DataFrame, int]:
    """(source, lo, rest, n; bits): of each source the range of 2^bits places from lo in which its budget runs out, what is left for it there, and its documents.

    Radix selection: words are summed by source and digit, the digit where the sum passes the
    budget is looked into again. The quality weights bend the keys' distribution as they like.
    """
    at = params.where("left > 0").select("source", F.lit(0).cast("long").alias("lo"), F.col("left").alias("rest"), "n")
    bits = PLACE_BITS
    while bits and not at.where(F.col("n") > RANGE_ROWS).isEmpty():
        size, bits = 1 << bits, bits - min(bits, DIGIT_BITS)
        rows = _with(keys, at.drop("n"), small, ["source"]).where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("lo") + F.lit(size)))
        digit = F.shiftright(F.col("place") - F.col("lo"), bits)
        sums = rows.groupBy("source", "lo", "rest", digit.alias("digit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        cut = sums.withColumn("upto", F.sum("words").over(upto)).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
        cut = cut.select("source", (F.col("lo") + F.col("digit") * F.lit(1 << bits)).alias("lo"), (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"), "n")
        at = common.written(cut)
    return at, bits


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = RATIO, epochs: int = EPOCHS) -> DataFrame:
    """kept, source, size, source_size, target, taken for rows of common.written(scored()), which are read several times.

    A source's target is spent on whole epochs first. What is left goes to its documents in
    order of their sampling keys: those before the crossing document are taken once more, the
    crossing one in part, so a source's taken words are its target rounded down. Null sources
    are one source, ordered last; documents without words take 0. Rows equal in key and text
    draw alike and split what is left for them evenly (rounded down).

    Only sums by source and digit of the keys, and the documents of one key range a source, are
    shuffled, never a whole source: a source that holds most rows costs no task more.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    params = source_targets(sizes, weights, ratio, epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    params = params.select("source", "source_size", "target", "n", full.alias("full")).withColumn(
        "left", F.floor(F.col("target") - F.col("full") * F.col("source_size")).cast("long")
    )
    params = common.written(params)
    small = params.count() <= BROADCAST_SOURCES
    whole = float(1 << PLACE_BITS)
    place = F.least(F.floor((F.lit(1.0) - F.exp(-F.col("skey"))) * F.lit(whole)), F.lit((1 << PLACE_BITS) - 1)).cast("long")
    keys = rows.select("source", "size", "skey", "rk", place.alias("place"))
    at, bits = _crossing_ranges(keys, params, small)
    # documents of the range in which a source's budget runs out, equal rows as one
    inside = _with(keys, at.drop("n"), small, ["source"]).where((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("lo") + F.lit(1 << bits)))
    groups = inside.groupBy("source", "skey", "rk", "size", "rest").agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("source").orderBy("skey", "rk").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("words", F.col("size") * F.col("copies")).withColumn("upto", F.sum("words").over(order))
    cross = groups.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    cross = cross.select(
        "source",
        F.struct("skey", "rk").alias("edge"),
        F.floor((F.col("rest") - F.col("upto") + F.col("words")) / F.col("copies")).cast("long").alias("part"),
    )
    params = params.select("source", "source_size", "target", "full").alias("p").join(cross.alias("c"), F.expr("p.source <=> c.source"), "left")
    params = common.written(params.select("p.*", "c.edge", "c.part"))
    me = F.struct("skey", "rk")
    # no crossing document: nothing is left after the whole epochs
    extra = F.when(F.col("edge").isNull(), F.lit(0)).when(me < F.col("edge"), F.col("size")).when(me == F.col("edge"), F.col("part")).otherwise(F.lit(0))
    taken = F.col("full") * F.col("size") + extra
    return _with(rows, params, small, ["source"]).select("kept", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op8_mix_sources(spark, sf_dir):
    """The mix of all `documents`."""
    rows = scored(common.table(spark, sf_dir, "documents"), F.col("doc_id"))
    return mix(common.written(rows)).select(F.col("kept").alias("doc_id"), "size", "source_size", "target", "taken")


OP8_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
  -ln((('0x' || substr(md5(coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce('+' || text, '-')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE)
  / greatest(pow(1 - coalesce(length(text) - length(translate(text, '0123456789#$%&*+/<=>@\\^_`{|}~', '')), 0)::DOUBLE / greatest(length(coalesce(text, '')), 1), 2), 0.25) AS skey
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, cap::DOUBLE / w AS ratio, row_number() OVER o AS nth,
  (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM r WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
f AS (SELECT arg_min(level, nth) AS final FROM l WHERE ratio >= level),
t AS (SELECT source, source_size, CASE WHEN final IS NULL OR ratio <= final THEN cap::DOUBLE ELSE w * final END AS target FROM l, (SELECT max(final) AS final FROM f)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
x AS (SELECT d.*, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size)::BIGINT AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.skey) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN upto <= rest THEN size ELSE greatest(0, rest - (upto - size)) END)::BIGINT AS taken FROM x
"""
