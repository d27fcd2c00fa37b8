"""Queries over derived boards: colours, geometry, statistics, layout, editing, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from pinwall.functions import color as C
from pinwall.functions import geometry as G
from pinwall.functions import text as T
from pinwall.functions.constants import PALETTE
from pinwall.operators import boards as B
from pinwall.operators.stats import nearest_rank
from pinwall.plans.bridge import EDGES, NOTES, edges, notes, table
from pinwall.sources import board_json, exports


def _r(df, *cols, places=4):
    # adding 0.0 turns a rounded negative zero into zero
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in cols})


def _lab_sql(src: str, cols: str, color: str = "color") -> str:
    lin = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END"
    piv = lambda v: f"CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE {v} * 7.787 + 16.0::DOUBLE / 116 END"
    return f"""(SELECT {cols}, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b FROM (SELECT *, {piv('xx')} AS fx, {piv('yy')} AS fy, {piv('zz')} AS fz FROM (
 SELECT *, (lr * 0.4124564 + lg * 0.3575761 + lb * 0.1804375) / 0.95047 AS xx, lr * 0.2126729 + lg * 0.7151522 + lb * 0.072175 AS yy, (lr * 0.0193339 + lg * 0.119192 + lb * 0.9503041) / 1.08883 AS zz FROM (
 SELECT *, {lin('cr')} AS lr, {lin('cg')} AS lg, {lin('cb')} AS lb FROM (SELECT *, ('0x' || substr({color}, 2, 2))::INT::DOUBLE AS cr, ('0x' || substr({color}, 4, 2))::INT::DOUBLE AS cg, ('0x' || substr({color}, 6, 2))::INT::DOUBLE AS cb FROM {src})))))"""


_PALETTE = "palette AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '#{h}', '{n}')" for i, (h, _, n) in enumerate(PALETTE)) + ") t(ord, color, name))"
_DIST = """sqrt(pow((n.l - p.l) * 0.30, 2) + pow((n.c - p.c) * 0.52, 2) + pow(2 * sqrt(n.c * p.c) * sin((CASE WHEN abs(n.h - p.h) > pi() THEN 2 * pi() - abs(n.h - p.h) ELSE abs(n.h - p.h) END) / 2) * 1.08, 2))
 + CASE WHEN n.c >= 6 AND p.c < 4 THEN 14 ELSE 0 END + CASE WHEN n.c < 4 AND p.c >= 14 THEN 14 ELSE 0 END"""
_RANKED = f"""WITH {NOTES}, {_PALETTE}, pl AS (SELECT ord, color, l, sqrt(a * a + b * b) AS c, atan2(b, a) AS h FROM {_lab_sql('palette', 'ord, color')}),
nl AS (SELECT board_id, note_id, confidence, l, sqrt(a * a + b * b) AS c, atan2(b, a) AS h FROM {_lab_sql('notes', 'board_id, note_id, confidence')}),
d AS (SELECT n.board_id, n.note_id, n.confidence, p.color, p.ord, {_DIST} AS distance FROM nl n CROSS JOIN pl p),
r AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY distance, ord) AS place FROM d)"""


def board_color_summary(spark, sf):
    """Per board and palette colour: notes, rounded mean confidence, unsure notes."""
    rows = B.color_notes(notes(spark, sf))
    return rows.groupBy("board_id", "palette").agg(
        F.count(F.lit(1)).alias("n"), T.js_round(F.avg("confidence")).cast("long").alias("mean_confidence"), F.count(F.when(F.col("confidence") < 70, 1)).alias("n_low")
    )


BOARD_COLOR_SUMMARY = _RANKED + " SELECT board_id, color AS palette, count(*) AS n, floor(avg(confidence) + 0.5)::BIGINT AS mean_confidence, count(*) FILTER (confidence < 70) AS n_low FROM r WHERE place = 1 GROUP BY ALL"


def lab_color(spark, sf):
    return _r(C.with_lab(notes(spark, sf).select("note_id", "color"), F.col("color")).drop("color"), "l", "a", "b")


LAB_COLOR = f"WITH {NOTES} SELECT note_id, round(l, 4) + 0.0 AS l, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b FROM {_lab_sql('notes', 'note_id')}"


def nearest_palette(spark, sf):
    return B.color_notes(notes(spark, sf)).select("note_id", "palette")


NEAREST_PALETTE = _RANKED + " SELECT note_id, color AS palette FROM r WHERE place = 1"


def palette_top4(spark, sf):
    n = C.with_palette(C.with_lab(notes(spark, sf).select("note_id", "color"), F.col("color")))
    ranked = n.select("note_id", F.posexplode(F.slice("ranking", 1, 4)).alias("i", "e"))
    return _r(ranked.select("note_id", (F.col("i") + 1).cast("long").alias("place"), F.col("e.hex").alias("palette"), "e.distance"), "distance")


PALETTE_TOP4 = _RANKED + " SELECT note_id, place, color AS palette, round(distance, 4) AS distance FROM r WHERE place <= 4"


def _messy(spark, sf):
    k = F.col("note_id")
    messy = F.when(k % 4 == 0, F.concat(F.lit(" "), F.substring("color", 2, 3))).when(k % 4 == 1, F.upper("color")).when(k % 4 == 2, F.lit("red")).otherwise(F.substring("color", 2, 6))
    return notes(spark, sf).select("note_id", messy.alias("messy"))


_MESSY = "messy AS (SELECT note_id, CASE note_id % 4 WHEN 0 THEN ' ' || substr(color, 2, 3) WHEN 1 THEN upper(color) WHEN 2 THEN 'red' ELSE substr(color, 2, 6) END AS messy FROM notes)"
_FULL = "CASE WHEN regexp_full_match(d, '[0-9A-Fa-f]{3}') THEN '#' || upper(regexp_replace(d, '(.)', '\\1\\1', 'g')) WHEN regexp_full_match(d, '[0-9A-Fa-f]{6}') THEN '#' || upper(d) ELSE '#F7DC68' END"


def normalize_hex(spark, sf):
    m = F.col("messy")
    return _messy(spark, sf).select("note_id", C.normalize_hex(m).alias("hex"), C.clean_hex(F.trim(m), "F7DC68").alias("slide_hex"), F.lower(C.normalize_hex(m, upper=False)).alias("visual_hex"))


NORMALIZE_HEX = f"""WITH {NOTES}, {_MESSY}, t AS (SELECT note_id, regexp_replace(trim(messy), '^#', '') AS d FROM messy)
SELECT note_id, {_FULL} AS hex, CASE WHEN regexp_full_match(upper(d), '[0-9A-F]{{6}}') THEN upper(d) ELSE 'F7DC68' END AS slide_hex, lower({_FULL}) AS visual_hex FROM t"""


def color_name(spark, sf):
    return notes(spark, sf).select("note_id", C.color_name(F.col("color")).alias("name"))


COLOR_NAME = f"""WITH {NOTES}, {_PALETTE}, c AS (SELECT 1 AS s, note_id AS id, NULL AS ord, NULL AS name, color FROM notes UNION ALL SELECT 2, NULL, ord, name, color FROM palette),
x AS (SELECT *, ('0x' || substr(color, 2, 2))::INT AS r, ('0x' || substr(color, 4, 2))::INT AS g, ('0x' || substr(color, 6, 2))::INT AS b FROM c),
d AS (SELECT n.id AS note_id, p.name, row_number() OVER (PARTITION BY n.id ORDER BY pow(n.r - p.r, 2) + pow(n.g - p.g, 2) + pow(n.b - p.b, 2), p.ord) AS place FROM x n JOIN x p ON n.s = 1 AND p.s = 2)
SELECT note_id, name FROM d WHERE place = 1"""


def color_groups(spark, sf):
    return _r(B.color_groups(notes(spark, sf)), "l", "a", "b")


COLOR_GROUPS = f"WITH {NOTES}, g AS (SELECT board_id, lower(color) AS hex, count(*) AS n FROM notes GROUP BY ALL) SELECT board_id, hex, n, round(l, 4) + 0.0 AS l, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b FROM {_lab_sql('g', 'board_id, hex, n', 'hex')}"


def board_stats(spark, sf):
    out = B.board_stats(notes(spark, sf))
    return out.withColumn("mean_confidence", F.col("mean_confidence").cast("long"))


BOARD_STATS = f"WITH {NOTES} SELECT board_id, count(*) AS n_notes, floor(avg(confidence) + 0.5)::BIGINT AS mean_confidence, count(*) FILTER (confidence < 70) AS n_low FROM notes GROUP BY board_id"


def _quad():
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    lean = F.col("rotation") / 10
    return F.array(G.point(x + lean, y), G.point(x + w, y + lean), G.point(x + w - lean, y + h), G.point(x, y + h - lean))


_QUAD = "q AS (SELECT *, x + rotation / 10 AS x0, y AS y0, x + width AS x1, y + rotation / 10 AS y1, x + width - rotation / 10 AS x2, y + height AS y2, x AS x3, y + height - rotation / 10 AS y3 FROM notes)"


def quad_to_board(spark, sf):
    n = notes(spark, sf).withColumn("b", G.quad_to_board(_quad(), F.lit(160.0), F.lit(100.0)))
    return _r(n.select("note_id", "b.*"), "x", "y", "width", "height", "rotation")


QUAD_TO_BOARD = f"""WITH {NOTES}, {_QUAD}, s AS (SELECT note_id, least(greatest((sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) + sqrt(pow(x2 - x3, 2) + pow(y2 - y3, 2))) / 2 / 160 * 100, 0.6), 100) AS width,
 least(greatest((sqrt(pow(x3 - x0, 2) + pow(y3 - y0, 2)) + sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2))) / 2 / 100 * 100, 0.6), 100) AS height,
 (x0 + x1 + x2 + x3) / 4 / 160 * 100 AS cx, (y0 + y1 + y2 + y3) / 4 AS cy, degrees(atan2(y1 - y0, x1 - x0)) AS turn FROM q)
SELECT note_id, round(cx - width / 2, 4) + 0.0 AS x, round(cy - height / 2, 4) + 0.0 AS y, round(width, 4) AS width, round(height, 4) AS height, CASE WHEN abs(turn) < 0.08 THEN 0.0 ELSE round(turn, 4) + 0.0 END AS rotation FROM s"""


def polygon_area(spark, sf):
    n = notes(spark, sf).withColumn("q", _quad())
    inside = G.inside(F.col("q"), F.col("x") + F.col("pos") % 7 * 3, F.col("y") + F.col("pos") % 5 * 4)
    p = G.project(F.col("q"), F.lit(0.25), F.lit(0.75))
    out = n.select("note_id", G.signed_area(F.col("q")).alias("signed"), G.area(F.col("q")).alias("area"), inside.alias("inside"), p["x"].alias("px"), p["y"].alias("py"))
    return _r(out, "signed", "area", "px", "py")


POLYGON_AREA = f"""WITH {NOTES}, {_QUAD}, t AS (SELECT *, x + pos % 7 * 3 AS u, y + pos % 5 * 4 AS v FROM q), c AS (SELECT *, unnest([(x1 - x0) * (v - y0) - (y1 - y0) * (u - x0), (x2 - x1) * (v - y1) - (y2 - y1) * (u - x1),
 (x3 - x2) * (v - y2) - (y3 - y2) * (u - x2), (x0 - x3) * (v - y3) - (y0 - y3) * (u - x3)]) AS k FROM t),
i AS (SELECT note_id, NOT (bool_or(k >= 1e-5) AND bool_or(k <= -1e-5)) AS inside FROM c GROUP BY note_id),
h AS (SELECT *, x0 - x1 + x2 - x3 AS sx, y0 - y1 + y2 - y3 AS sy, x1 - x2 AS dx1, y1 - y2 AS dy1, x3 - x2 AS dx2, y3 - y2 AS dy2 FROM q),
m AS (SELECT *, dx1 * dy2 - dx2 * dy1 AS det FROM h),
g AS (SELECT *, CASE WHEN abs(sx) < 1e-9 AND abs(sy) < 1e-9 OR abs(det) < 1e-9 THEN 0 ELSE (sx * dy2 - dx2 * sy) / det END AS gg, CASE WHEN abs(sx) < 1e-9 AND abs(sy) < 1e-9 OR abs(det) < 1e-9 THEN 0 ELSE (dx1 * sy - sx * dy1) / det END AS hh FROM m),
a AS (SELECT *, (x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2 AS s, gg * 0.25 + hh * 0.75 + 1 AS w FROM g)
SELECT a.note_id, round(s, 4) + 0.0 AS signed, round(abs(s), 4) AS area, inside, round(((x1 - x0 + gg * x1) * 0.25 + (x3 - x0 + hh * x3) * 0.75 + x0) / w, 4) + 0.0 AS px, round(((y1 - y0 + gg * y1) * 0.25 + (y3 - y0 + hh * y3) * 0.75 + y0) / w, 4) + 0.0 AS py FROM a JOIN i ON a.note_id = i.note_id"""


def edge_curves(spark, sf):
    out = B.edge_curves(notes(spark, sf), edges(spark, sf))
    return _r(out, *(f"{a}{i}" for a in "xy" for i in range(4)))


EDGE_CURVES = f"""WITH {NOTES}, {EDGES}, c AS (SELECT board_id, note_id, x + width / 2 AS cx, y + height / 2 AS cy FROM notes),
j AS (SELECT e.*, s.cx AS sx, s.cy AS sy, t.cx AS tx, t.cy AS ty, greatest(5, abs(t.cx - s.cx) * 0.32) AS bend FROM edges e JOIN c s ON e.board_id = s.board_id AND e.source_id = s.note_id JOIN c t ON e.board_id = t.board_id AND e.target_id = t.note_id)
SELECT board_id, source_id, target_id, round(sx, 4) AS x0, round(sy, 4) AS y0, round(sx + bend, 4) + 0.0 AS x1, round(sy, 4) AS y1, round(tx - bend, 4) + 0.0 AS x2, round(ty, 4) AS y2, round(tx, 4) AS x3, round(ty, 4) AS y3 FROM j"""


def cascade_delete(spark, sf):
    n, e = notes(spark, sf), edges(spark, sf)
    kept, left = B.delete_notes(n, e, n.where("note_id % 7 = 3"))
    a = kept.groupBy("board_id").agg(F.count(F.lit(1)).alias("n_notes"))
    b = left.groupBy("board_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return a.join(b, "board_id", "left").fillna(0, ["n_edges"])


CASCADE_DELETE = f"""WITH {NOTES}, {EDGES}, a AS (SELECT board_id, count(*) AS n_notes FROM notes WHERE note_id % 7 <> 3 GROUP BY board_id), b AS (SELECT board_id, count(*) AS n_edges FROM edges WHERE source_id % 7 <> 3 AND target_id % 7 <> 3 GROUP BY board_id)
SELECT a.board_id, n_notes, coalesce(n_edges, 0) AS n_edges FROM a LEFT JOIN b ON a.board_id = b.board_id"""


def connect_notes(spark, sf):
    n, e = notes(spark, sf), edges(spark, sf)
    wanted = n.select("board_id", F.col("note_id").alias("source_id"), (F.floor(F.col("note_id") / 20) * 20 + F.col("note_id") * 3 % 20).alias("target_id"))
    return B.connect(e, wanted.unionByName(wanted))


CONNECT_NOTES = f"WITH {NOTES}, {EDGES} SELECT board_id, source_id, target_id FROM edges UNION SELECT board_id, note_id, (note_id // 20) * 20 + note_id * 3 % 20 FROM notes WHERE note_id <> (note_id // 20) * 20 + note_id * 3 % 20"


def edit_notes(spark, sf):
    n = notes(spark, sf).withColumn("raw_text", F.when(F.col("note_id") % 5 == 0, F.upper("text"))).withColumn("raw_confidence", F.when(F.col("note_id") % 5 == 0, F.col("confidence") - 10))
    edited = B.edit_text(n, n.where("note_id % 3 = 1").select("board_id", "note_id", F.lit("by hand").alias("new_text")))
    moved = B.move(edited, n.where("note_id % 2 = 0").select("board_id", "note_id", F.lit(30.0).alias("dx"), F.lit(-20.0).alias("dy")))
    sized = B.resize(moved, n.where("note_id % 2 = 1").select("board_id", "note_id", F.lit(6.0).alias("dx"), F.lit(-15.0).alias("dy")))
    back = B.restore_original(sized)
    return _r(back.select("note_id", "text", "confidence", "x", "y", "width", "height"), "x", "y", "width", "height")


EDIT_NOTES = f"""WITH {NOTES}, e AS (SELECT *, CASE WHEN note_id % 5 = 0 THEN upper(text) WHEN note_id % 3 = 1 THEN 'by hand' ELSE text END AS t, CASE WHEN note_id % 5 = 0 THEN confidence - 10 WHEN note_id % 3 = 1 THEN 100 ELSE confidence END AS c,
 CASE WHEN note_id % 2 = 0 THEN least(greatest(x + 30, 0), 100 - width) ELSE least(greatest(x, 0), 100 - width) END AS nx, CASE WHEN note_id % 2 = 0 THEN least(greatest(y - 20, 0), 100 - height) ELSE least(greatest(y, 0), 100 - height) END AS ny,
 CASE WHEN note_id % 2 = 1 THEN 6.0 ELSE 0.0 END::DOUBLE AS dx, CASE WHEN note_id % 2 = 1 THEN -15.0 ELSE 0.0 END::DOUBLE AS dy FROM notes)
SELECT note_id, t AS text, c AS confidence, round(nx, 4) AS x, round(ny, 4) AS y, round(least(greatest(width + dx * cos(radians(rotation)) + dy * sin(radians(rotation)), 4), 100 - nx), 4) AS width,
 round(least(greatest(height + dy * cos(radians(rotation)) - dx * sin(radians(rotation)), 4), 100 - ny), 4) AS height FROM e"""


def add_notes(spark, sf):
    n = notes(spark, sf)
    wanted = n.select("board_id").distinct().select("board_id", (-1 - F.col("board_id")).alias("note_id"), F.lit(40.0).alias("x"), F.lit(35.0).alias("y"), F.lit("new").alias("text"))
    return B.add_notes(n, wanted).where("origin = 'manual'").select("board_id", "note_id", "pos", "z_index", "color", "text", "confidence")


ADD_NOTES = f"""WITH {NOTES}, {_PALETTE}, t AS (SELECT board_id, max(z_index) + 1 AS z_index, count(*) AS n FROM notes GROUP BY board_id)
SELECT board_id, -1 - board_id AS note_id, n AS pos, z_index, p.color, 'new' AS text, 100::BIGINT AS confidence FROM t JOIN palette p ON p.ord = t.n % 8"""


def overlap_pairs(spark, sf):
    return _r(B.overlapping(notes(spark, sf)), "shared")


OVERLAP_PAIRS = f"""WITH {NOTES}, p AS (SELECT a.board_id, a.note_id AS lower_id, b.note_id AS upper_id, greatest(0, least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) AS shared
 FROM notes a JOIN notes b ON a.board_id = b.board_id AND a.pos < b.pos) SELECT board_id, lower_id, upper_id, round(shared, 4) AS shared FROM p WHERE shared > 0"""


def tidy_columns(spark, sf):
    return _r(B.tidy_columns(notes(spark, sf)).withColumn("columns", F.col("columns").cast("long")), "cell_width", "cell_height", "note_width", "note_height")


TIDY_COLUMNS = f"""WITH {NOTES}, n AS (SELECT board_id, count(*) AS n FROM notes GROUP BY board_id), t AS (SELECT *, unnest(range(1, least(n, 10) + 1)) AS columns FROM n),
r AS (SELECT *, ceil(n / columns)::BIGINT AS rows FROM t), c AS (SELECT *, (94 - 1.5::DOUBLE * (columns - 1)) / columns AS cell_width, (92 - 2.0::DOUBLE * (rows - 1)) / rows AS cell_height FROM r),
w AS (SELECT *, least(22, cell_width * 0.9, cell_height * 0.9 / 1.6) AS note_width FROM c WHERE cell_width > 0 AND cell_height > 0),
b AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY note_width DESC, columns) AS place FROM w WHERE note_width > 1)
SELECT board_id, n, columns, rows, round(cell_width, 4) AS cell_width, round(cell_height, 4) AS cell_height, round(note_width, 4) AS note_width, round(note_width * 1.6, 4) AS note_height FROM b WHERE place = 1"""


def slide_shapes(spark, sf):
    out = exports.slide_shapes(notes(spark, sf), edges(spark, sf), 1.6)
    return _r(out.where("kind = 'note'").select("board_id", "note_id", "x", "y", "w", "h", "fill", "font_size"), "x", "y", "w", "h", "font_size")


_AVAIL_H, _BW = 7.5 - 0.68, (7.5 - 0.68) * 1.6
SLIDE_SHAPES = f"""WITH {NOTES}, s AS (SELECT board_id, note_id, text, color, (13.333::DOUBLE - {_BW}::DOUBLE) / 2 + x / 100 * {_BW}::DOUBLE AS x, 0.34::DOUBLE + y / 100 * {_AVAIL_H}::DOUBLE AS y, greatest(0.08, width / 100 * {_BW}::DOUBLE) AS w, greatest(0.08, height / 100 * {_AVAIL_H}::DOUBLE) AS h FROM notes)
SELECT board_id, note_id, round(x, 4) AS x, round(y, 4) AS y, round(w, 4) AS w, round(h, 4) AS h, upper(substr(color, 2, 6)) AS fill, round(least(greatest(floor(least(sqrt(greatest(0.02, w * h) / greatest(4, length(trim(text)))) * 34, h * 22) * 10 + 0.5) / 10, 8), 22), 4) AS font_size FROM s"""


def csv_lines(spark, sf):
    n = notes(spark, sf).withColumn("text", F.when(F.col("pos") % 6 == 0, F.concat(F.lit("=1+\""), "text")).otherwise(F.col("text")))
    rows = n.select("board_id", (F.col("pos") + 1).alias("number"), F.when(F.col("pos") % 3 > 0, F.col("pos") % 4 + 1).alias("row"), F.when(F.col("pos") % 3 > 0, F.col("pos") % 5 + 1).alias("column"), C.color_name(F.col("color")).alias("color"), C.normalize_hex(F.col("color")).alias("color_hex"), "text")
    return exports.csv_lines(rows).select("board_id", "number", F.regexp_replace("line", "\"[^\"]*\";\"#", "\"?\";\"#").alias("line"))


CSV_LINES = f"""WITH {NOTES}, n AS (SELECT *, CASE WHEN pos % 6 = 0 THEN '=1+"' || text ELSE text END AS t FROM notes)
SELECT board_id, pos + 1 AS number, '"' || (pos + 1) || '";' || CASE WHEN pos % 3 > 0 THEN '"' || (pos % 4 + 1) || '";"' || (pos % 5 + 1) || '";' ELSE ';;' END || '"?";"' || upper(color) || '";"' || CASE WHEN t[1] IN ('=', '+', '@', '-') THEN '''' ELSE '' END || replace(t, '"', '""') || '"' AS line FROM n"""


def json_roundtrip(spark, sf):
    n = notes(spark, sf)
    boards = n.select("board_id").distinct().select("board_id", F.lit("original").alias("layout_mode"), F.lit(1.6).alias("aspect_ratio"), F.lit("x.png").alias("file_name"))
    docs = board_json.export_boards(boards, n, edges(spark, sf).withColumn("edge_id", F.concat_ws("-", "source_id", "target_id")), created_at="2024-01-01T00:00:00Z")
    back, _ = board_json.import_boards(docs)
    out = board_json.notes_of(back)
    return out.select(F.col("board_id").cast("long"), F.col("note_id").cast("long").alias("note_id"), "pos", "x", "y", "width", "height", "rotation", "z_index", "color", "text", "confidence", "origin")


JSON_ROUNDTRIP = f"WITH {NOTES} SELECT board_id, note_id, pos, x, y, width, height, rotation, z_index, color, text, confidence, 'scan' AS origin FROM notes"


def nearest_rank_percentile(spark, sf):
    t = table(spark, sf, "lineitem")
    # quantities have few distinct values: count them first, so that no group of rows meets in one list
    counts = t.groupBy("l_returnflag", "l_linestatus", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return nearest_rank(counts, ["l_returnflag", "l_linestatus"], "l_quantity", "n", [0.28, 0.5, 0.94])


NEAREST_RANK_PERCENTILE = """WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem),
p AS (SELECT unnest([0.28, 0.5, 0.94])::DOUBLE AS p) SELECT l_returnflag, l_linestatus, p, l_quantity AS value FROM r JOIN p ON r.i = floor(p.p * (n - 1) + 0.5)"""

PAIRS = {
    "board_color_summary": (board_color_summary, BOARD_COLOR_SUMMARY),
    "lab_color": (lab_color, LAB_COLOR),
    "nearest_palette": (nearest_palette, NEAREST_PALETTE),
    "palette_top4": (palette_top4, PALETTE_TOP4),
    "normalize_hex": (normalize_hex, NORMALIZE_HEX),
    "color_name": (color_name, COLOR_NAME),
    "color_groups": (color_groups, COLOR_GROUPS),
    "board_stats": (board_stats, BOARD_STATS),
    "quad_to_board": (quad_to_board, QUAD_TO_BOARD),
    "polygon_geometry": (polygon_area, POLYGON_AREA),
    "edge_curves": (edge_curves, EDGE_CURVES),
    "cascade_delete": (cascade_delete, CASCADE_DELETE),
    "connect_notes": (connect_notes, CONNECT_NOTES),
    "edit_notes": (edit_notes, EDIT_NOTES),
    "add_notes": (add_notes, ADD_NOTES),
    "overlap_pairs": (overlap_pairs, OVERLAP_PAIRS),
    "tidy_columns": (tidy_columns, TIDY_COLUMNS),
    "slide_shapes": (slide_shapes, SLIDE_SHAPES),
    "csv_lines": (csv_lines, CSV_LINES),
    "json_roundtrip": (json_roundtrip, JSON_ROUNDTRIP),
    "nearest_rank_percentile": (nearest_rank_percentile, NEAREST_RANK_PERCENTILE),
}
