"""Token counts: an exact histogram of encoded lengths whose suffix sums answer every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinwall.llm import common, tokens

#: Lengths are gathered into ranges of so many tokens; a range is one window group of at most as many rows.
RANGE = 1024
#: Files of the written histogram: k different lengths need k^2 / 2 tokens, so 10^12 tokens have at most 1.4 million rows.
FILES = 4


def encoded_lengths(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens (long): the length of every whole text; null and empty texts have 0 tokens."""
    path = tokenizer_path or tokens.default_path()

    def make():
        enc = tokens.encoder(path)

        def each(cols):
            return {"key": cols["key"], "n_tokens": [len(enc.ids(t)) // 4 for t in cols["text"]]}

        return each

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    made = common.over_rows(rows, "key long, n_tokens long", pa.schema([("key", pa.int64()), ("n_tokens", pa.int64())]), make)
    return made.withColumnRenamed("key", key)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row for each distinct length, with sums that answer questions at any context limit.

    length, n_docs, n_tokens: documents of this length and their tokens; docs_at_least,
    tokens_at_least: suffix sums; total_docs, total_tokens: of the corpus; truncated_tokens:
    what is left when every document is cut to `length`; quantile: share of documents not
    longer. No documents give no rows. A length that most documents share costs one row for
    each map task, as counts are summed before they are shuffled; suffix sums run inside
    ranges of RANGE lengths, and what lies above a range is added from the ranges' sums.
    """
    # written out: three plans below read the histogram, and encoding is the expensive part
    counts = lengths.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # lengths are counted in all shuffle partitions, but each file costs its executor a writer and several short-lived processes
    parts = min(FILES, int(lengths.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hist = common.written(counts.withColumn("bin", F.floor(F.col("length") / RANGE)).repartition(parts))
    bins = hist.groupBy("bin").agg(F.sum("n_docs").alias("bin_docs"), F.sum("n_tokens").alias("bin_tokens"))
    above = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    bins = bins.select(
        "bin",
        F.coalesce(F.sum("bin_docs").over(above), zero).alias("docs_above"),
        F.coalesce(F.sum("bin_tokens").over(above), zero).alias("tokens_above"),
        F.sum("bin_docs").over(whole).alias("total_docs"),
        F.sum("bin_tokens").over(whole).alias("total_tokens"),
    )
    inner = Window.partitionBy("bin").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(bins, "bin").select(
        "length",
        "n_docs",
        "n_tokens",
        (F.sum("n_docs").over(inner) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum("n_tokens").over(inner) + F.col("tokens_above")).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    longer = F.col("docs_at_least") - F.col("n_docs")
    return out.withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least")).withColumn(
        "quantile", (F.col("total_docs") - longer) / F.col("total_docs")
    )


def at_limit(histogram: DataFrame, limit: int) -> DataFrame:
    """n_docs, n_tokens, truncated_tokens, n_longer of the corpus at any context limit: one row of sums over the histogram."""
    cut = F.least(F.col("length"), F.lit(limit))
    return histogram.agg(
        F.sum("n_docs").alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(cut * F.col("n_docs")).alias("truncated_tokens"),
        F.sum(F.when(F.col("length") > limit, F.col("n_docs")).otherwise(0)).alias("n_longer"),
    )


def quantile_length(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least `share` of the documents don't exceed (one row; null for no documents)."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("length").alias("length"))


def op5_token_counts(spark, sf_dir):
    """Histogram of `documents` under the default tokenizer."""
    return length_histogram(encoded_lengths(common.table(spark, sf_dir, "documents")))
