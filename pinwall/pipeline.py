"""The three paths of the engine, composed: photos to notes, crops to texts, notes to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.operators import boards, correction, crops, fusion, layout, recovery, segmentation, symbols_text
from pinwall.sources import board_json, exports, readers


def photos_to_notes(photos: DataFrame, mode: str = "BGR") -> DataFrame:
    """Notes in percent of their photo, with corners, colour and stacking order; board_id is photo_id.

    photos: photo_id, height, width, n_channels, data.
    """
    import numpy as np
    import pandas as pd

    cut = segmentation.segment(photos, mode)
    papers = recovery.recover_photos(cut, segmentation.components(cut))
    lists = papers.groupBy("photo_id").agg(F.sort_array(F.collect_list(F.struct("geom_id", "cluster", "corners", "min_x", "max_x", "min_y", "max_y"))).alias("papers"))
    rows = cut.select("photo_id", F.col("width").alias("mask_width"), F.col("height").alias("mask_height"), "step", "labels", "centroids").join(lists, "photo_id").join(photos, "photo_id")

    def run(frames):
        for g in frames:
            out = []
            for p in g.itertuples():
                labels = np.frombuffer(p.labels, np.uint8).reshape(p.mask_height, p.mask_width)
                image = segmentation.as_rgb(p.data, p.height, p.width, p.n_channels, mode)
                quads = []
                for s in p.papers:
                    box = (s["min_x"], s["max_x"], s["min_y"], s["max_y"])
                    quads.append(np.array([list(c) for c in s["corners"]]) if s["corners"] is not None else crops.mask_quad(labels, s["cluster"], box))
                layers = layout.stacking([s["cluster"] for s in p.papers], quads, labels)
                for s, q, layer in zip(p.papers, quads, layers):
                    lab = crops.paper_lab(image, (q + 0.5) * p.step, np.array(list(p.centroids[s["cluster"]])))
                    out.append((p.photo_id, s["geom_id"], p.step, p.width, p.height, layer, [{"x": float(x), "y": float(y)} for x, y in q], *map(float, lab)))
            yield pd.DataFrame(out, columns=["board_id", "note_id", "step", "photo_width", "photo_height", "layer", "corners", "l", "a", "b"])

    kind = "board_id long, note_id long, step int, photo_width int, photo_height int, layer int, corners array<struct<x:double,y:double>>, l double, a double, b double"
    from pinwall.functions import color as C

    placed = boards.place_quads(rows.mapInPandas(run, kind))
    colored = C.with_palette(placed).withColumn("color", F.col("ranking")[0]["hex"])
    return colored.select("board_id", "note_id", F.col("note_id").alias("pos"), "x", "y", "width", "height", "rotation", "z_index", "corners", "color", F.lit("scan").alias("origin"))


def read_notes(notes: DataFrame, first: DataFrame, more: list, lexicons: DataFrame, found_symbols: DataFrame | None = None) -> DataFrame:
    """Final texts of all notes: the reader cascade, fusion, correction, and symbols last.

    first: evidence of the first reader; more: functions from weak notes to further evidence.
    """
    words = lexicons.select("word")
    seen = readers.cascade(first, more, words)
    selected = fusion.fuse_notes(seen, words).select("board_id", "note_id", "text", "confidence", "engine")
    raw = correction.assemble(notes, selected)
    fixed = correction.correct_notes(raw.where("engine <> 'none'"), seen, lexicons)
    out = raw.select("board_id", "note_id", "engine", F.col("text").alias("t"), F.col("confidence").alias("c")).join(fixed, ["board_id", "note_id"], "left")
    out = out.select("board_id", "note_id", "engine", F.coalesce("raw_text", "t").alias("raw_text"), F.col("c").alias("raw_confidence"), F.coalesce("text", "t").alias("text"), F.coalesce("confidence", "c").alias("confidence"), F.coalesce("corrections", F.array()).alias("corrections"))
    return symbols_text.with_symbols(out, found_symbols) if found_symbols is not None else out


def notes_to_files(board: DataFrame, notes: DataFrame, edges: DataFrame, created_at: str, aspect: float = 1.6) -> dict[str, DataFrame]:
    """JSON of the notes where they are; CSV, spreadsheet and slides of what the layout mode shows. board: board_id, layout_mode, aspect_ratio, file_name."""
    tidy = boards.tidy_layout(notes, layout.reading_order(notes), aspect)
    shown = boards.displayed(notes, tidy, board)
    rows = layout.spreadsheet_rows(shown)
    return {
        "json": board_json.export_boards(board, notes, edges, created_at),
        "csv": exports.csv_documents(rows),
        "xlsx": exports.workbooks(rows),
        "pptx": exports.presentations(exports.slide_shapes(shown, edges, aspect)),
    }


