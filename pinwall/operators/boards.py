"""Boards as tables: statistics, editing verbs, layout search, history. Built-in operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinwall.functions import color as C
from pinwall.functions import geometry as G
from pinwall.functions import text as T
from pinwall.functions.constants import PALETTE
from pinwall.operators.symbols_text import append_manual

LOW_CONFIDENCE = 70
HISTORY = 40
MIN_SIZE = 4.0


def color_notes(notes: DataFrame) -> DataFrame:
    """notes with Lab coordinates of their colour, the nearest palette colour and its German name."""
    rows = C.with_palette(C.with_lab(notes, C.normalize_hex(F.col("color"))))
    return rows.withColumn("palette", F.col("ranking")[0]["hex"]).withColumn("color_name", C.color_name(F.col("color"))).drop("ranking")


def board_stats(notes: DataFrame) -> DataFrame:
    """n_notes, rounded mean confidence and the number of unsure notes of each board."""
    return notes.groupBy("board_id").agg(
        F.count(F.lit(1)).alias("n_notes"),
        T.js_round(F.avg("confidence")).alias("mean_confidence"),
        F.count(F.when(F.col("confidence") < LOW_CONFIDENCE, 1)).alias("n_low"),
    )


def color_groups(notes: DataFrame) -> DataFrame:
    """How many notes of a board have which colour, with the colour's Lab coordinates."""
    counts = notes.groupBy("board_id", F.lower(C.normalize_hex(F.col("color"))).alias("hex")).agg(F.count(F.lit(1)).alias("n"))
    return C.with_lab(counts, F.col("hex"))


def centers(notes: DataFrame) -> DataFrame:
    return notes.select("board_id", "note_id", (F.col("x") + F.col("width") / 2).alias("cx"), (F.col("y") + F.col("height") / 2).alias("cy"))


def edge_curves(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """Control points of every edge whose two notes exist."""
    c = centers(notes)
    s = c.select("board_id", F.col("note_id").alias("source_id"), F.col("cx").alias("sx"), F.col("cy").alias("sy"))
    t = c.select("board_id", F.col("note_id").alias("target_id"), F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    out = edges.join(s, ["board_id", "source_id"]).join(t, ["board_id", "target_id"])
    return out.select("board_id", "source_id", "target_id", G.curve(F.col("sx"), F.col("sy"), F.col("tx"), F.col("ty")).alias("curve")).select("board_id", "source_id", "target_id", "curve.*")


def delete_notes(notes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Notes and edges without the notes of gone (board_id, note_id) and the edges that touch them."""
    kept = notes.join(gone.select("board_id", "note_id"), ["board_id", "note_id"], "left_anti")
    for side in ("source_id", "target_id"):
        edges = edges.join(gone.select("board_id", F.col("note_id").alias(side)), ["board_id", side], "left_anti")
    return kept, edges


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("board_id", "edge_id"), ["board_id", "edge_id"], "left_anti")


def connect(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges with the wanted ones (board_id, source_id, target_id) that are no loops and not there yet."""
    new = wanted.where("source_id <> target_id").select("board_id", "source_id", "target_id").distinct()
    new = new.join(edges, ["board_id", "source_id", "target_id"], "left_anti")
    return edges.select("board_id", "source_id", "target_id").unionByName(new)


def add_notes(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """A manual note on top of each wanted board (board_id, note_id, x, y, text), in the palette's next colour."""
    tops = notes.groupBy("board_id").agg(F.max(F.coalesce("z_index", F.col("pos") + 2)).alias("top"), F.count(F.lit(1)).alias("n"))
    color = F.element_at(F.array(*(F.lit(f"#{h}") for h, _, _ in PALETTE)), (F.col("n") % len(PALETTE) + 1).cast("int"))
    new = wanted.join(tops, "board_id", "left").fillna({"top": 1, "n": 0})
    new = new.select("board_id", "note_id", F.col("n").cast("long").alias("pos"), "x", "y", F.lit(20.0).alias("width"), F.lit(19.0).alias("height"), F.lit(0.0).alias("rotation"), (F.greatest(F.lit(1), "top") + 1).cast("long").alias("z_index"), color.alias("color"), "text", F.lit(100).cast("long").alias("confidence"), F.lit("manual").alias("origin"))
    return notes.unionByName(new, allowMissingColumns=True)


def edit_text(notes: DataFrame, edits: DataFrame) -> DataFrame:
    """Text set by hand (board_id, note_id, new_text): sure, and without corrections."""
    joined = notes.join(edits.select("board_id", "note_id", "new_text"), ["board_id", "note_id"], "left")
    done = F.col("new_text").isNotNull()
    if "corrections" in notes.columns:
        joined = joined.withColumn("corrections", F.when(done, F.array().cast(notes.schema["corrections"].dataType)).otherwise(F.col("corrections")))
    return joined.withColumn("text", F.coalesce("new_text", "text")).withColumn("confidence", F.when(done, F.lit(100).cast("long")).otherwise(F.col("confidence"))).drop("new_text")


def insert_symbol(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """A symbol put into a note's text by hand (board_id, note_id, symbol); the text is sure then."""
    put = notes.join(wanted.select("board_id", "note_id", "symbol"), ["board_id", "note_id"])
    edits = put.select("board_id", "note_id", append_manual(F.col("text"), F.col("symbol")).alias("new_text"))
    return edit_text(notes, edits)


def restore_original(notes: DataFrame) -> DataFrame:
    """Text and confidence as read, where they were kept."""
    return notes.withColumn("text", F.coalesce("raw_text", "text")).withColumn("confidence", F.coalesce("raw_confidence", "confidence"))


def move(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Notes shifted by dx, dy (percent of the board), kept on the board."""
    j = notes.join(moves, ["board_id", "note_id"], "left").fillna(0.0, ["dx", "dy"])
    x = F.least(F.greatest(F.col("x") + F.col("dx"), F.lit(0.0)), 100 - F.col("width"))
    y = F.least(F.greatest(F.col("y") + F.col("dy"), F.lit(0.0)), 100 - F.col("height"))
    return j.withColumn("x", x).withColumn("y", y).drop("dx", "dy")


def resize(notes: DataFrame, drags: DataFrame) -> DataFrame:
    """Notes resized by a pointer's way (dx, dy in percent of the board), turned into the note's own axes; at least MIN_SIZE, at most to the border."""
    j = notes.join(drags, ["board_id", "note_id"], "left").fillna(0.0, ["dx", "dy"])
    a = F.radians(F.coalesce("rotation", F.lit(0.0)))
    dw, dh = F.col("dx") * F.cos(a) + F.col("dy") * F.sin(a), F.col("dy") * F.cos(a) - F.col("dx") * F.sin(a)
    w = F.least(F.greatest(F.col("width") + dw, F.lit(MIN_SIZE)), 100 - F.col("x"))
    h = F.least(F.greatest(F.col("height") + dh, F.lit(MIN_SIZE)), 100 - F.col("y"))
    return j.withColumn("width", w).withColumn("height", h).drop("dx", "dy")


def overlapping(notes: DataFrame) -> DataFrame:
    """Pairs of a board's notes (by position) whose boxes share an area, and its size."""
    a, b = notes.alias("a"), notes.alias("b")

    def shared(lo: str, size: str):
        return G.overlap(F.col(f"a.{lo}"), F.col(f"a.{lo}") + F.col(f"a.{size}"), F.col(f"b.{lo}"), F.col(f"b.{lo}") + F.col(f"b.{size}"))

    both = shared("x", "width") * shared("y", "height")
    pairs = a.join(b, (F.col("a.board_id") == F.col("b.board_id")) & (F.col("a.pos") < F.col("b.pos")) & (both > 0))
    return pairs.select("a.board_id", F.col("a.note_id").alias("lower_id"), F.col("b.note_id").alias("upper_id"), both.alias("shared"))


def tidy_columns(notes: DataFrame, aspect: float = 1.6) -> DataFrame:
    """For each board the number of columns (1 to 10) that lets notes be widest, with cell and note sizes in percent; the fewest columns win a tie.

    Boards of so many notes that none fits get one column and notes 1 wide, which leave the board.
    """
    aspect = min(3.0, max(0.5, aspect or 1.6))
    n = notes.groupBy("board_id").agg(F.count(F.lit(1)).alias("n"))
    tried = n.withColumn("columns", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int"))))
    rows = F.ceil(F.col("n") / F.col("columns"))
    cell_w, cell_h = (94 - (F.col("columns") - 1) * 1.5) / F.col("columns"), (92 - (rows - 1) * 2.0) / rows
    width = F.least(F.lit(22.0), cell_w * 0.9, cell_h * 0.9 / aspect)
    tried = tried.select("board_id", "n", "columns", rows.alias("rows"), cell_w.alias("cell_width"), cell_h.alias("cell_height"), width.alias("note_width")).where("cell_width > 0 and cell_height > 0 and note_width > 1")
    best = tried.groupBy("board_id").agg(F.max_by(F.struct("columns", "rows", "cell_width", "cell_height", "note_width"), F.struct("note_width", -F.col("columns"))).alias("b"))
    none = F.struct(F.lit(1).alias("columns"), F.col("n").alias("rows"), F.lit(94.0).alias("cell_width"), F.lit(1.0).alias("cell_height"), F.lit(1.0).alias("note_width"))
    out = n.join(best, "board_id", "left").withColumn("b", F.coalesce("b", none))
    return out.select("board_id", "n", "b.*").withColumn("note_height", F.col("note_width") * aspect)


def tidy_layout(notes: DataFrame, reading: DataFrame, aspect: float = 1.6) -> DataFrame:
    """Notes without turn or overlap in reading order; reading has board_id, note_id, place (from 0), see layout.reading_order."""
    j = notes.join(reading, ["board_id", "note_id"]).join(tidy_columns(notes, aspect).drop("n"), "board_id")
    col, row = F.col("place") % F.col("columns"), F.floor(F.col("place") / F.col("columns"))
    x = 3.0 + col * (F.col("cell_width") + 1.5) + (F.col("cell_width") - F.col("note_width")) / 2
    y = 4.0 + row * (F.col("cell_height") + 2.0) + (F.col("cell_height") - F.col("note_height")) / 2
    keep = [c for c in notes.columns if c not in ("x", "y", "width", "height", "rotation", "z_index")]
    return j.select(*keep, x.alias("x"), y.alias("y"), F.col("note_width").alias("width"), F.col("note_height").alias("height"), F.lit(0.0).alias("rotation"), (F.col("place") + 2).alias("z_index"))


def displayed(notes: DataFrame, tidy: DataFrame, boards: DataFrame) -> DataFrame:
    """What exports show: the tidy frame for boards whose layout_mode is "tidy", else the notes as they are."""
    mode = boards.select("board_id", "layout_mode")
    plain = notes.join(mode.where("layout_mode <> 'tidy'"), "board_id").drop("layout_mode")
    return plain.unionByName(tidy.join(mode.where("layout_mode = 'tidy'"), "board_id").drop("layout_mode").select(*plain.columns))


def place_quads(proposals: DataFrame) -> DataFrame:
    """Notes in percent from sample quads: corners (array of points), step, photo_width, photo_height, layer."""
    pts = F.transform("corners", lambda p: F.struct(((p["x"] + 0.5) * F.col("step")).alias("x"), ((p["y"] + 0.5) * F.col("step")).alias("y")))
    rows = proposals.withColumn("quad", pts)
    box = G.quad_to_board(F.col("quad"), F.col("photo_width"), F.col("photo_height"))
    percent = F.transform("quad", lambda p: F.struct(T.clamp(p["x"] / F.col("photo_width") * 100, 0.0, 100.0).alias("x"), T.clamp(p["y"] / F.col("photo_height") * 100, 0.0, 100.0).alias("y")))
    return rows.withColumn("box", box).withColumn("corners", percent).withColumn("z_index", F.col("layer") + 2).drop("quad").select("*", "box.*").drop("box")


def history_tail(snapshots: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The last `keep` versions of each board."""
    order = Window.partitionBy("board_id").orderBy(F.col("version").desc())
    return snapshots.withColumn("back", F.row_number().over(order)).where(F.col("back") <= keep)


def push(history: DataFrame, snapshots: DataFrame, keep: int = HISTORY) -> DataFrame:
    """history (board_id, version, state) after new snapshots (board_id, version): they stand on what is current, what could be redone goes, the last `keep` stay."""
    boards = snapshots.select("board_id").distinct()
    changed = history.join(boards, "board_id", "left_semi").where("state <> 'redo'").select("board_id", "version").unionByName(snapshots.select("board_id", "version"))
    tail = history_tail(changed, keep).withColumn("state", F.when(F.col("back") == 1, "current").otherwise("undo"))
    return history.join(boards, "board_id", "left_anti").select("board_id", "version", "state").unionByName(tail.select("board_id", "version", "state"))


def redo(history: DataFrame) -> DataFrame:
    """history one version forward, where there is one that was undone: the oldest of those is current."""
    ahead = F.min(F.when(F.col("state") == "redo", F.col("version"))).over(Window.partitionBy("board_id"))
    state = F.when(F.col("ahead").isNull(), F.col("state")).when(F.col("version") == F.col("ahead"), "current").when(F.col("version") < F.col("ahead"), "undo").otherwise("redo")
    return history.withColumn("ahead", ahead).withColumn("state", state).select("board_id", "version", "state")


def undo(snapshots: DataFrame) -> DataFrame:
    """Each board one version back: what stands before the newest is current, the newest can be redone."""
    tail = history_tail(snapshots)
    return tail.withColumn("state", F.when(F.col("back") == 1, "redo").when(F.col("back") == 2, "current").otherwise("undo"))


def latest_scan(results: DataFrame) -> DataFrame:
    """Results of the newest scan generation of each board; late results of older scans go."""
    newest = F.max("generation").over(Window.partitionBy("board_id"))
    return results.withColumn("newest", newest).where(F.col("generation") == F.col("newest")).drop("newest")


def analysis_step(progress):
    """1 to 6 from the percentage of an analysis."""
    return F.when(progress < 10, 1).when(progress < 35, 2).when(progress < 41, 3).when(progress < 85, 4).when(progress < 95, 5).otherwise(6)


def accept_uploads(files: DataFrame, limit: int = 24 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files by media type and size; files has path, length, media_type."""
    fine = F.col("media_type").startswith("image/") & (F.col("length") <= limit)
    return files.where(fine), files.where(~F.coalesce(fine, F.lit(False)))
