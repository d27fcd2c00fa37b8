"""Boards as JSON documents (version 4): one string a board, and back with the defaults of missing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMAT = "pinwall-board"

_NOTE = "struct<id:string,x:double,y:double,width:double,height:double,rotation:string,zIndex:string,origin:string,color:string,text:string,confidence:bigint,rawText:string,rawConfidence:bigint>"
_EDGE = "struct<id:string,sourceId:string,targetId:string>"
SCHEMA = f"format string, version int, createdAt string, layoutMode string, source struct<fileName:string,photoIncluded:boolean,aspectRatio:string>, notes array<{_NOTE}>, edges array<{_EDGE}>"


def export_boards(boards: DataFrame, notes: DataFrame, edges: DataFrame, created_at: str, format_id: str = FORMAT) -> DataFrame:
    """board_id, json. Notes keep their original places whatever the layout mode; evidence isn't exported; null fields are left out.

    boards: board_id, layout_mode, aspect_ratio, file_name; a board's notes are gathered in one
    row (tens of them), in order of pos.
    """
    opt = [c for c in ("raw_text", "raw_confidence") if c in notes.columns]
    names = {"raw_text": "rawText", "raw_confidence": "rawConfidence"}
    note = F.struct(
        F.col("note_id").cast("string").alias("id"), "x", "y", "width", "height", "rotation", F.col("z_index").alias("zIndex"), "origin", "color", "text", F.col("confidence").cast("long").alias("confidence"), *(F.col(c).alias(names[c]) for c in opt)
    )
    n = notes.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct("pos", note.alias("n")))).alias("rows"))
    e = edges.groupBy("board_id").agg(F.array_sort(F.collect_list(F.struct(F.col("edge_id").cast("string").alias("id"), F.col("source_id").cast("string").alias("sourceId"), F.col("target_id").cast("string").alias("targetId")))).alias("edges"))
    j = boards.join(n, "board_id", "left").join(e, "board_id", "left")
    payload = F.struct(
        F.lit(format_id).alias("format"),
        F.lit(4).alias("version"),
        F.lit(created_at).alias("createdAt"),
        F.col("layout_mode").alias("layoutMode"),
        F.struct(F.col("file_name").alias("fileName"), F.lit(False).alias("photoIncluded"), F.col("aspect_ratio").alias("aspectRatio")).alias("source"),
        F.transform("rows", lambda r: r["n"]).alias("notes"),
        F.col("edges"),
    )
    # a board without notes or edges has empty lists, not missing ones
    text = F.to_json(payload)
    text = F.when(F.col("rows").isNull(), F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"notes":[]}'))).otherwise(text)
    text = F.when(F.col("edges").isNull(), F.concat(F.regexp_replace(text, r"\}$", ""), F.lit(',"edges":[]}'))).otherwise(text)
    return j.select("board_id", text.alias("json"))


def _number(text: Column) -> Column:
    """The number that a field holds; empty text counts as 0, what is no finite number as null."""
    value = F.when(F.trim(text) == "", 0.0).otherwise(text.try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def import_boards(documents: DataFrame, formats: tuple[str, ...] = (FORMAT,)) -> tuple[DataFrame, DataFrame]:
    """(boards, rejects) of documents (board_id, json).

    A document is accepted if its format is one of `formats` and it has lists of notes and
    edges; the version isn't looked at. layout_mode is "tidy" or else "original", aspect_ratio
    1.6 unless it is a number other than 0.
    """
    rows = documents.withColumn("b", F.from_json("json", SCHEMA, {"mode": "PERMISSIVE"}))
    fine = F.coalesce(F.col("b.format").isin(*formats) & F.col("b.notes").isNotNull() & F.col("b.edges").isNotNull(), F.lit(False))
    aspect = _number(F.col("b.source.aspectRatio"))
    good = rows.where(fine).select(
        "board_id",
        F.when(F.col("b.layoutMode") == "tidy", "tidy").otherwise("original").alias("layout_mode"),
        F.when(aspect != 0, aspect).otherwise(F.lit(1.6)).alias("aspect_ratio"),
        F.coalesce("b.source.fileName", F.lit("imported")).alias("file_name"),
        F.col("b.notes").alias("notes"),
        F.col("b.edges").alias("edges"),
    )
    return good, rows.where(~fine).select("board_id", "json")


def notes_of(boards: DataFrame) -> DataFrame:
    """Notes of imported boards: rotation 0, z_index position + 2 and origin "import" where missing or no number."""
    rows = boards.select("board_id", F.posexplode("notes").alias("pos", "n"))
    # a JSON null counts as 0 in both fields, a missing one too: from_json can't tell them apart
    z = F.when(F.col("n.zIndex").isNull(), F.col("pos") + 2).otherwise(F.coalesce(_number(F.col("n.zIndex")), F.col("pos") + 2))
    return rows.select(
        "board_id",
        F.col("n.id").alias("note_id"),
        F.col("pos").cast("long").alias("pos"),
        "n.x",
        "n.y",
        "n.width",
        "n.height",
        F.coalesce(_number(F.col("n.rotation")), F.lit(0.0)).alias("rotation"),
        z.cast("long").alias("z_index"),
        "n.color",
        "n.text",
        "n.confidence",
        F.coalesce("n.origin", F.lit("import")).alias("origin"),
    )


def edges_of(boards: DataFrame) -> DataFrame:
    rows = boards.select("board_id", F.posexplode("edges").alias("pos", "e"))
    return rows.select("board_id", F.col("pos").cast("long").alias("pos"), F.col("e.id").alias("edge_id"), F.col("e.sourceId").alias("source_id"), F.col("e.targetId").alias("target_id"))
