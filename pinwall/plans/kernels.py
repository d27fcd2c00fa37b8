"""Queries through grouped kernels, and those over step matrices and label grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pinwall.operators import boards as B
from pinwall.operators import correction, crops, ctc, fold, layout, recovery, segmentation, symbols
from pinwall.operators import symbols_text as X
from pinwall.plans.bridge import EVIDENCE, NOTES, WIDE, evidence, lexicon, notes, table
from pinwall.sources import exports

_CLASSES, _ALPHABET = 8, "abcdefg"


def fold_evidence(spark, sf):
    return fold.fold_evidence(evidence(spark, sf)).drop("board_id", "place", "variant", "scope", "line_index")


# the fold of measured readings is the two windows of evidence_retention
FOLD_EVIDENCE = f"""WITH {NOTES}, {EVIDENCE}, n AS (SELECT *, regexp_replace(lower(replace(text, '{WIDE}', 'a')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS norm FROM evidence),
d AS (SELECT *, row_number() OVER (PARTITION BY note_id, engine, norm ORDER BY confidence DESC, seq) AS r FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY note_id, engine ORDER BY confidence DESC, seq) AS place FROM d WHERE r = 1) SELECT note_id, seq, engine, text, confidence FROM p WHERE place <= 4"""


def correct_text(spark, sf):
    n = notes(spark, sf).select("board_id", "note_id", "text", "confidence", F.lit("paddle").alias("engine"))
    lexicons = lexicon(spark, sf).select(F.lit("en").alias("lang"), "word")
    return correction.correct_notes(n, evidence(spark, sf), lexicons)


def suggest_words(spark, sf):
    seen = evidence(spark, sf).select(F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("word")).where("word <> ''")
    found = correction.suggestions(seen, lexicon(spark, sf).select(F.lit("en").alias("lang"), "word"))
    return found.select("word", "suggestion", F.col("edits").cast("long").alias("edits"))


def reading_order(spark, sf):
    return layout.reading_order(notes(spark, sf))


def tidy_layout(spark, sf):
    n = notes(spark, sf)
    return B.tidy_layout(n, layout.reading_order(n)).select("board_id", "note_id", "x", "y", "width", "height", "z_index")


def axis_grid(spark, sf):
    return layout.axis_grid(notes(spark, sf))


def spreadsheet(spark, sf):
    return layout.spreadsheet_rows(notes(spark, sf))


def board_files(spark, sf):
    """Sizes of every board's CSV, spreadsheet and slide files."""
    n = notes(spark, sf)
    rows = layout.spreadsheet_rows(n)
    from pinwall.plans.bridge import edges

    made = exports.csv_documents(rows).join(exports.workbooks(rows), "board_id").join(exports.presentations(exports.slide_shapes(n, edges(spark, sf))), "board_id")
    return made.select("board_id", F.length("csv").alias("csv"), F.length("xlsx").alias("xlsx"), F.length("pptx").alias("pptx"))


def ctc_decode(spark, sf):
    best = ctc.best_classes(F.col("embedding"), _CLASSES)
    rows = table(spark, sf, "embeddings").select("vec_id", best.alias("best"))
    return rows.select("vec_id", ctc.text_of(F.col("best"), _ALPHABET).alias("text"))


CTC_DECODE = """WITH s AS (SELECT vec_id, unnest(range(0, 8)) AS step, embedding FROM embeddings),
c AS (SELECT vec_id, step, list_position(embedding[step * 8 + 1 : step * 8 + 8], list_max(embedding[step * 8 + 1 : step * 8 + 8])) - 1 AS best FROM s),
l AS (SELECT *, lag(best) OVER (PARTITION BY vec_id ORDER BY step) AS before FROM c)
SELECT vec_id, coalesce(string_agg(substr('abcdefg', best::BIGINT, 1), '' ORDER BY step) FILTER (best <> 0 AND (before IS NULL OR before <> best)), '') AS text FROM l GROUP BY vec_id"""


def symbol_reconcile(spark, sf):
    k = F.col("note_id")
    text = F.when(k % 5 == 0, "11").when(k % 5 == 1, " V ").when(k % 5 == 2, "").otherwise(F.col("text"))
    one = F.struct(F.when(k % 3 == 0, "!").otherwise(X.HEART).alias("symbol"), (k * 7 % 20 + 80).cast("int").alias("confidence"), (k % 10 / 10.0).alias("dominant_ink"))
    rows = notes(spark, sf).select("note_id", text.alias("text"), F.array(one).alias("symbols"))
    return rows.select("note_id", X.reconcile(F.col("text"), F.col("symbols")).alias("text"))


SYMBOL_RECONCILE = f"""WITH {NOTES}, s AS (SELECT note_id, CASE note_id % 5 WHEN 0 THEN '11' WHEN 1 THEN ' V ' WHEN 2 THEN '' ELSE text END AS t, CASE WHEN note_id % 3 = 0 THEN '!' ELSE '♥' END AS symbol, note_id * 7 % 20 + 80 AS c, note_id % 10 / 10.0::DOUBLE AS ink FROM notes)
SELECT note_id, CASE WHEN symbol = '♥' AND c >= 88 AND ink >= 0.75 AND regexp_full_match(replace(t, ' ', ''), '([Il1]{{2}}|[VvWw]|<3)') THEN '♥' WHEN contains(t, symbol) THEN trim(t) WHEN trim(t) = '' THEN symbol ELSE trim(t) || chr(10) || symbol END AS text FROM s"""

_GRID = 24


def _grid(spark, sf):
    """A label grid for each nation: 24 x 24 labels by a modular rule with stripes."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(_GRID * _GRID - 1)), lambda i: (F.floor(i / (F.col("n_nationkey") % 5 + 2)) + F.floor(i / _GRID) * (i % 3)) % 4)
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("photo_id"), cells.alias("cells"))


def majority_filter(spark, sf):
    def run(frames):
        for g in frames:
            out = []
            for p in g.itertuples():
                made = segmentation.majority(np.array(p.cells, np.uint8).reshape(_GRID, _GRID), 4)
                out.append(pd.DataFrame({"photo_id": p.photo_id, "cell": range(_GRID * _GRID), "label": made.ravel().astype(int)}))
            yield pd.concat(out) if out else pd.DataFrame({"photo_id": [], "cell": [], "label": []})

    return _grid(spark, sf).mapInPandas(run, "photo_id long, cell long, label long")


_CELLS = f"cells AS (SELECT n_nationkey::BIGINT AS photo_id, i AS cell, i // {_GRID} AS y, i % {_GRID} AS x, ((i // (n_nationkey % 5 + 2)) + (i // {_GRID}) * (i % 3)) % 4 AS label FROM nation, range({_GRID * _GRID}) t(i))"
MAJORITY_FILTER = f"""WITH {_CELLS}, v AS (SELECT a.photo_id, a.cell, a.label, b.label AS vote, count(*) AS n FROM cells a JOIN cells b ON a.photo_id = b.photo_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY photo_id, cell ORDER BY n DESC, vote <> label, vote) AS place FROM v)
SELECT photo_id, cell, (CASE WHEN n >= 5 THEN vote ELSE label END)::BIGINT AS label FROM r WHERE place = 1"""


def connected_components(spark, sf):
    def run(frames):
        for g in frames:
            out = [(p.photo_id, int(n), int((m == n).sum())) for p in g.itertuples() for m in [segmentation.islands(np.array(p.cells, np.uint8).reshape(_GRID, _GRID))] for n in range(m.max() + 1)]
            yield pd.DataFrame(out, columns=["photo_id", "island", "count"])

    return _grid(spark, sf).mapInPandas(run, "photo_id long, island long, count long").groupBy("photo_id", "count").agg(F.count(F.lit(1)).alias("islands"))


CONNECTED_COMPONENTS = f"""WITH RECURSIVE {_CELLS}, e AS (SELECT a.photo_id, a.cell AS u, b.cell AS v FROM cells a JOIN cells b ON a.photo_id = b.photo_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.label = b.label),
w AS (SELECT photo_id, cell AS root, cell FROM cells UNION SELECT w.photo_id, w.root, e.v FROM w JOIN e ON w.photo_id = e.photo_id AND w.cell = e.u WHERE e.v > w.root),
m AS (SELECT photo_id, cell, min(root) AS root FROM w GROUP BY ALL), c AS (SELECT photo_id, root, count(*) AS count FROM m GROUP BY ALL)
SELECT photo_id, count, count(*) AS islands FROM c GROUP BY photo_id, count"""


def _photos(spark, sf):
    """A drawn photo of three papers for each nation."""
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("photo_id"))

    def run(frames):
        for g in frames:
            out = []
            for k in g.photo_id.tolist():
                p = np.full((180, 240, 3), 128, np.uint8)
                for i, c in enumerate(((247, 220, 104), (242, 163, 180), (169, 217, 238))):
                    x, y = 20 + 72 * i, 40 + k % 7 * 3
                    p[y : y + 54, x : x + 54] = c
                    p[y + 20 : y + 24, x + 8 : x + 40] = 40
                out.append((k, 180, 240, 3, p.tobytes()))
            yield pd.DataFrame(out, columns=["photo_id", "height", "width", "n_channels", "data"])

    return rows.mapInPandas(run, "photo_id long, height int, width int, n_channels int, data binary")


def recover_geometry(spark, sf):
    cut = segmentation.segment(_photos(spark, sf), "RGB")
    return recovery.recover_photos(cut, segmentation.components(cut)).drop("corners")


def scan_photos(spark, sf):
    from pinwall import pipeline

    return pipeline.photos_to_notes(_photos(spark, sf), "RGB").drop("corners")


def prepare_crops(spark, sf):
    n = _photos(spark, sf).select("photo_id", F.lit(0).cast("long").alias("note_id"), F.lit(20 / 2.4).alias("x"), F.lit(22.0).alias("y"), F.lit(54 / 2.4).alias("width"), F.lit(30.0).alias("height"))
    made = crops.prepare_crops(_photos(spark, sf), n, "RGB")
    return made.select("photo_id", "note_id", "variant", "width", "height", "deskew_angle", F.size("bands").alias("n_bands"), F.crc32("data").alias("crc"))


def recognize_symbols(spark, sf):
    n = _photos(spark, sf).select("photo_id", F.lit(0).cast("long").alias("note_id"), F.lit(20 / 2.4).alias("x"), F.lit(22.0).alias("y"), F.lit(54 / 2.4).alias("width"), F.lit(30.0).alias("height"))
    return symbols.recognize_crops(crops.prepare_crops(_photos(spark, sf), n, "RGB"))


PAIRS = {
    "fold_evidence": (fold_evidence, FOLD_EVIDENCE),
    "correct_text": (correct_text, None),
    "suggest_words": (suggest_words, None),
    "reading_order": (reading_order, None),
    "tidy_layout": (tidy_layout, None),
    "axis_grid": (axis_grid, None),
    "spreadsheet": (spreadsheet, None),
    "board_files": (board_files, None),
    "ctc_decode": (ctc_decode, CTC_DECODE),
    "symbol_reconcile": (symbol_reconcile, SYMBOL_RECONCILE),
    "majority_filter": (majority_filter, MAJORITY_FILTER),
    "connected_components": (connected_components, CONNECTED_COMPONENTS),
    "recover_geometry": (recover_geometry, None),
    "scan_photos": (scan_photos, None),
    "prepare_crops": (prepare_crops, None),
    "recognize_symbols": (recognize_symbols, None),
}
