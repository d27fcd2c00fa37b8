"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir), works on every row
of docs and returns a DataFrame, which run() writes as Parquet and reads again for the next
stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinwall.llm import common, line_dedup, mixing, neardup, packing, toxicity


def _as_documents(rows: DataFrame, columns: list[str], text) -> DataFrame:
    """The input's columns from `row`, with another text and its length where there is such a column."""
    out = []
    for c in columns:
        if c == "text":
            out.append(text.alias(c))
        elif c == "n_chars":
            out.append(F.coalesce(F.length(text), F.lit(0)).cast("long").alias(c))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return rows.select(*out)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of the labels doesn't predict as toxic.

    Each row is judged by its own text, so repeated rows share their fate; null and empty texts
    score what a text without words does. Without labelled documents the model's start decides,
    and nothing goes. An empty table stays empty.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(model)("text") < toxicity.THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; those of which no line is left go.

    Null texts, empty ones and those of fewer lines stay as they are. Rows equal in doc_id and
    text are one occurrence and keep the same lines; null ids come first in the order.
    """
    found = line_dedup.line_dedup(docs)
    kept = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _as_documents(kept, docs.columns, F.col("kept_text"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): that of the smallest (id, row key).

    Rows equal in id and text are one document: that whose other columns have the smallest
    digest stays. Rows of one id whose texts aren't alike are different documents. Rows without
    words or an id are in no group and all stay, repeated ones once.
    """
    found = neardup.near_duplicates(docs)
    # the kept rows of a group share its smallest id
    alone = F.when(F.col("group").isNull(), F.col("rk"))
    kept = found.where("kept").groupBy("group", alone.alias("alone")).agg(F.min("rk").alias("rk")).select("rk")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), common.row_key().alias("rk"))
    rows = rows.join(kept.hint("merge"), "rk", "left_semi")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return rows.groupBy("rk").agg(F.min_by("row", F.md5(F.to_json(F.struct(F.lit(0).alias("_"), *others)))).alias("row")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document once for each epoch that takes it whole, and its first words where the budget takes a part; those of which nothing is taken go.

    Null and empty texts have no words and go. Null sources are one source, the last. Rows equal
    in doc_id and text draw alike; a source's taken words are its target, rounded down. The rows
    and their sizes are written once; only sizes and keys are read until the last pass.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    mixed = mixing.mix(common.written(mixing.scored(docs, row))).withColumnRenamed("kept", "row")
    text = F.col("row.text")
    # words with the blanks after them, so that what is kept of the text keeps its lines
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
    copies = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")))
    rows = mixed.where("taken > 0").withColumn("copy", F.explode(copies))
    rows = rows.withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    return _as_documents(rows, docs.columns, F.when(F.col("words") == F.col("size"), text).otherwise(part))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens.

    Null and empty texts are a piece of one token, the end; repeated rows are packed each; an
    empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("minhash_neardup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The model, near duplicates and tokens are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
    return docs
