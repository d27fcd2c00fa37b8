"""How recognised symbols and text come together. Built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEART = "♥"


def append_manual(text: Column, symbol: Column) -> Column:
    """A symbol put in by hand: after a space unless the text is empty or ends in a blank."""
    return F.when((F.length(text) == 0) | text.rlike(r"\s$"), F.concat(text, symbol)).otherwise(F.concat_ws(" ", text, symbol))


def merge(text: Column, symbols: Column) -> Column:
    """Trimmed text with the symbols (array<string>, in order) that it lacks, counting repeats, on a line of their own."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")

    def lacking(s: Column, i: Column) -> Column:
        """Whether fewer equal symbols come before this one than the text lacks."""
        before = F.size(F.filter(F.slice(symbols, F.lit(1), i), lambda t: t == s))
        present = (F.length(body) - F.length(F.replace(body, s, F.lit("")))) / F.length(s)
        return before < F.size(F.filter(symbols, lambda t: t == s)) - present

    missing = F.filter(symbols, lacking)
    tail = F.array_join(missing, " ")
    return F.when(F.size(missing) == 0, body).when(body == "", tail).otherwise(F.concat_ws("\n", body, tail))


def reconcile(text: Column, symbols: Column) -> Column:
    """Like merge; but a sole, sure, mostly inked heart replaces text that is only what hearts are misread as. symbols: array<struct<symbol, confidence, dominant_ink>>."""
    only = symbols[0]
    sure = (F.size(symbols) == 1) & (only["symbol"] == HEART) & (only["confidence"] >= 88) & (F.coalesce(only["dominant_ink"], F.lit(0.0)) >= 0.75)
    mistaken = F.regexp_replace(text, r"\s", "").rlike(r"^([Il1]{2}|[VvWw]|<3)$")
    return F.when(F.coalesce(sure & mistaken, F.lit(False)), only["symbol"]).otherwise(merge(text, F.transform(symbols, lambda s: s["symbol"])))


def with_symbols(results: DataFrame, symbols: DataFrame) -> DataFrame:
    """results (board_id, note_id, text, confidence) after correction with their notes' symbols; a note of symbols alone gets their mean confidence."""
    lists = symbols.groupBy("board_id", "note_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct("symbol", "confidence", "dominant_ink").alias("s")))), lambda x: x["s"]).alias("symbols"), F.avg("confidence").alias("mean")
    )
    j = results.join(lists, ["board_id", "note_id"], "left")
    has = F.col("symbols").isNotNull()
    merged = F.when(has, reconcile(F.col("text"), F.col("symbols"))).otherwise(F.col("text"))
    alone = F.array_join(F.transform("symbols", lambda s: s["symbol"]), " ")
    keep = ~has | ((F.trim("text") != "") & (merged != alone))
    out = j.withColumn("merged", merged).withColumn("confidence", F.when(keep, F.col("confidence")).otherwise(F.floor(F.col("mean") + 0.5).cast("long")))
    return out.withColumn("text", F.col("merged")).drop("merged", "mean")
