"""What a board tells about its language and its own words, before single notes are corrected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.functions import text as T
from pinwall.functions.constants import PROTECTED_TERMS


def board_words(texts: DataFrame, *keep: str) -> DataFrame:
    """keep columns and word for every word (letters or digits first) of column text."""
    return texts.select(*keep, F.explode(F.regexp_extract_all("text", F.lit(T.WORD_OR_NUMBER), F.lit(0))).alias("word"))


def language_preference(texts: DataFrame, lexicons: DataFrame) -> DataFrame:
    """board_id, german_only, english_only, preferred (null without a lead of 2): words of 3 letters or more that one lexicon alone has.

    lexicons: lang ("de" or "en"), word in lower case. The lexicons are joined, not broadcast by hand.
    """
    flags = lexicons.groupBy("word").agg(F.max((F.col("lang") == "de").cast("int")).alias("de"), F.max((F.col("lang") == "en").cast("int")).alias("en"))
    words = board_words(texts, "board_id").where(F.length("word") >= 3).select("board_id", F.lower("word").alias("word"))
    # words are counted before the join, so a frequent word is one row for each board
    counts = words.groupBy("board_id", "word").agg(F.count(F.lit(1)).alias("n")).join(flags, "word", "left")
    g, e = F.col("de") == 1, F.col("en") == 1
    out = counts.groupBy("board_id").agg(
        F.coalesce(F.sum(F.when(g & ~e, F.col("n"))), F.lit(0)).alias("german_only"), F.coalesce(F.sum(F.when(e & ~g, F.col("n"))), F.lit(0)).alias("english_only")
    )
    lead = F.when(F.col("english_only") >= F.col("german_only") + 2, "en").when(F.col("german_only") >= F.col("english_only") + 2, "de")
    return out.withColumn("preferred", lead)


def vocabulary_evidence(evidence: DataFrame, lexicon: DataFrame) -> DataFrame:
    """board_id, word, n_notes, n_sources, n_engines of words of 4 letters or more that neither the lexicon nor the protected terms have; whole-note readings only."""
    whole = evidence.where("scope = 'note'")
    words = board_words(whole, "board_id", "note_id", "engine", "variant").withColumn("word", F.lower("word"))
    words = words.where((F.length("word") >= 4) & ~F.col("word").isin(*PROTECTED_TERMS)).join(lexicon.select("word").distinct(), "word", "left_anti")
    source = F.concat_ws(":", "engine", F.coalesce("variant", F.lit("default")))
    return words.groupBy("board_id", "word").agg(F.count_distinct("note_id").alias("n_notes"), F.count_distinct(source).alias("n_sources"), F.count_distinct("engine").alias("n_engines"))


def board_vocabulary(seen: DataFrame, near_lexicon: DataFrame) -> DataFrame:
    """Words that a board may take for its own: in two notes, or read by two readers in two ways and not within one edit of a known word.

    near_lexicon: board_id, word of those that are; see correction.near_lexicon.
    """
    near = near_lexicon.select("board_id", "word").distinct().withColumn("near", F.lit(True))
    j = seen.join(near, ["board_id", "word"], "left")
    own = (F.col("n_notes") >= 2) | ((F.col("n_engines") >= 2) & (F.col("n_sources") >= 2) & F.col("near").isNull())
    return j.where(own).select("board_id", "word")
