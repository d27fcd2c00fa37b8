"""Note-board tables derived from the benchmark tables by plain arithmetic, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pinwall.operators import evidence as E


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 notes a board, from part."""
    k = F.col("p_partkey")
    hex_ = F.format_string("#%02x%02x%02x", k * 37 % 256, k * 59 % 256, k * 83 % 256)
    return table(spark, sf_dir, "part").select(
        F.floor(k / 20).alias("board_id"),
        (k % 20).alias("pos"),
        k.alias("note_id"),
        (k * 17 % 83).cast("double").alias("x"),
        (k * 29 % 81).cast("double").alias("y"),
        (k % 4 + 12).cast("double").alias("width"),
        (k % 3 + 14).cast("double").alias("height"),
        (k % 31 - 15).cast("double").alias("rotation"),
        (k % 20 + 2).alias("z_index"),
        hex_.alias("color"),
        F.col("p_name").alias("text"),
        (k * 7 % 60 + 40).alias("confidence"),
        F.lit("scan").alias("origin"),
    )


NOTES = """notes AS (SELECT p_partkey // 20 AS board_id, p_partkey % 20 AS pos, p_partkey AS note_id, (p_partkey * 17 % 83)::DOUBLE AS x,
 (p_partkey * 29 % 81)::DOUBLE AS y, (12 + p_partkey % 4)::DOUBLE AS width, (14 + p_partkey % 3)::DOUBLE AS height, (p_partkey % 31 - 15)::DOUBLE AS rotation,
 p_partkey % 20 + 2 AS z_index, format('#{:02x}{:02x}{:02x}', p_partkey * 37 % 256, p_partkey * 59 % 256, p_partkey * 83 % 256) AS color,
 p_name AS text, 40 + p_partkey * 7 % 60 AS confidence FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links inside a board, from lineitem; no loops."""
    k = F.col("l_partkey")
    target = F.floor(k / 20) * 20 + (F.col("l_suppkey") + F.col("l_linenumber")) % 20
    rows = table(spark, sf_dir, "lineitem").select(F.floor(k / 20).alias("board_id"), k.alias("source_id"), target.alias("target_id"))
    return rows.where("source_id <> target_id").distinct()


EDGES = """edges AS (SELECT DISTINCT l_partkey // 20 AS board_id, l_partkey AS source_id, (l_partkey // 20) * 20 + (l_suppkey + l_linenumber) % 20 AS target_id
 FROM lineitem WHERE l_partkey <> (l_partkey // 20) * 20 + (l_suppkey + l_linenumber) % 20)"""

_READERS = ("paddle", "dehtr", "tesseract")
_VARIANTS = ("rgb", "contrast", "gray")
#: A letter whose NFKC form is a plain a.
WIDE = "\uff41"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine readings a note: each reader misreads other letters, each variant drops or doubles something.

    Every sixth note ends in protected terms, and the gray variant of every sixth has full-width letters.
    Notes are dealt out by their key before they become nine rows each, so what goes by note needs no shuffle of readings.
    """
    n = notes(spark, sf_dir).select("board_id", "note_id", "text").repartition("board_id", "note_id")
    reads = []
    for i, reader in enumerate(_READERS):
        src, dst = (("o", "0"), ("rn", "m"), ("l", "1"))[i]
        for j, variant in enumerate(_VARIANTS):
            k = F.col("note_id") % 6
            base = F.concat(F.regexp_replace("text", src, dst), F.when(k == 1, " kanban api").otherwise(""))
            text = (base, F.regexp_replace(base, "e", "c"), F.when(k == 0, F.regexp_replace(base, "a", WIDE)).otherwise(F.concat(base, F.lit(" x"))))[j]
            conf = (F.col("note_id") * (7 + i) + F.lit(13 * j + 5 * i)) % 60 + 40
            reads.append(F.struct(F.lit(i * 3 + j).cast("long").alias("seq"), F.lit(reader).alias("engine"), F.lit(f"{reader}-{variant}").alias("variant"), text.alias("text"), conf.alias("confidence")))
    out = n.select("board_id", "note_id", F.explode(F.array(*reads)).alias("r"))
    return out.select("board_id", "note_id", "r.seq", "r.engine", "r.variant", F.lit("note").alias("scope"), F.lit(None).cast("int").alias("line_index"), "r.text", "r.confidence")


def _evidence_sql() -> str:
    parts = []
    for i, reader in enumerate(_READERS):
        src, dst = (("o", "0"), ("rn", "m"), ("l", "1"))[i]
        for j, variant in enumerate(_VARIANTS):
            base = f"(replace(text, '{src}', '{dst}') || CASE WHEN note_id % 6 = 1 THEN ' kanban api' ELSE '' END)"
            text = (base, f"replace({base}, 'e', 'c')", f"CASE WHEN note_id % 6 = 0 THEN replace({base}, 'a', '{WIDE}') ELSE {base} || ' x' END")[j]
            parts.append(
                f"SELECT board_id, note_id, {i * 3 + j}::BIGINT AS seq, '{reader}' AS engine, '{reader}-{variant}' AS variant, 'note' AS scope, {text} AS text, (note_id * {7 + i} + {13 * j + 5 * i}) % 60 + 40 AS confidence FROM notes"
            )
    return "evidence AS (" + " UNION ALL ".join(parts) + ")"


EVIDENCE = _evidence_sql()


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known words: those of part names with an even number of letters."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), r"[^a-z]+")).alias("word"))
    return words.where("length(word) > 0 and length(word) % 2 = 0").distinct()


LEXICON = """lexicon AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_split_to_array(lower(p_name), '[^a-z]+')) AS word FROM part) WHERE length(word) > 0 AND length(word) % 2 = 0)"""


def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.simulate(notes(spark, sf_dir))
