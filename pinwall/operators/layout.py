"""Order-dependent layout kernels: reading order, axis clusters, stacking order."""

from __future__ import annotations

from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinwall.functions import color as C

_GEOMETRY = ["board_id", "note_id", "pos", "x", "y", "width", "height"]


def reading_order(notes: DataFrame) -> DataFrame:
    """board_id, note_id, place (from 0): rows from top to bottom, notes of a row from left to right.

    Going down the board, a note joins the first row whose running mean centre is near enough.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos").assign(cx=lambda t: t.x + t.width / 2, cy=lambda t: t.y + t.height / 2)
        reach = max(2.5, sorted(g.height)[len(g) // 2] * 0.52)
        rows: list[list] = []
        for note in g.sort_values(["cy", "cx"], kind="stable").itertuples():
            home = next((r for r in rows if abs(np.mean([m.cy for m in r]) - note.cy) <= reach), None)
            if home is None:
                rows.append([note])
            else:
                home.append(note)
        rows.sort(key=lambda r: np.mean([m.cy for m in r]))
        ids = [m.note_id for r in rows for m in sorted(r, key=lambda m: m.cx)]
        return pd.DataFrame({"board_id": g.board_id.iloc[0], "note_id": ids, "place": range(len(ids))})

    return notes.select(*_GEOMETRY).groupBy("board_id").applyInPandas(run, "board_id long, note_id long, place long")


def _axis(centers: list[float], sizes: list[float]) -> tuple[list[int], list[int]]:
    """Cluster of each centre (from 1, in order of position) and the clusters' sizes: the nearest cluster within reach of its running mean, else a new one."""
    reach = max(2.6, median(sizes) * 0.38)
    groups: list[list[int]] = []
    for i in sorted(range(len(centers)), key=centers.__getitem__):
        gaps = [abs(centers[i] - sum(centers[j] for j in g) / len(g)) for g in groups]
        near = min(range(len(groups)), key=gaps.__getitem__, default=None)
        if near is not None and gaps[near] <= reach:
            groups[near].append(i)
        else:
            groups.append([i])
    groups.sort(key=lambda g: sum(centers[j] for j in g) / len(g))
    of = {i: n for n, g in enumerate(groups, 1) for i in g}
    return [of[i] for i in range(len(centers))], [len(g) for g in groups]


def axis_grid(notes: DataFrame) -> DataFrame:
    """board_id, note_id, row, column: null for boards that show no grid (no two notes in a line, unless there is only one note)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        rows, row_sizes = _axis((g.y + g.height / 2).tolist(), g.height.tolist())
        cols, col_sizes = _axis((g.x + g.width / 2).tolist(), g.width.tolist())
        grid = len(g) == 1 or max(row_sizes + col_sizes) >= 2
        return pd.DataFrame({"board_id": g.board_id, "note_id": g.note_id, "row": rows if grid else None, "column": cols if grid else None}).astype({"row": "Int64", "column": "Int64"})

    return notes.select(*_GEOMETRY).groupBy("board_id").applyInPandas(run, "board_id long, note_id long, row long, column long")


def spreadsheet_rows(notes: DataFrame) -> DataFrame:
    """board_id, number (from 1), row, column, color, color_hex, text, note_id in grid order, or by position without a grid."""
    j = notes.join(axis_grid(notes), ["board_id", "note_id"])
    order = Window.partitionBy("board_id").orderBy("row", "column", F.col("y") + F.col("height") / 2, F.col("x") + F.col("width") / 2, F.collate(F.col("note_id").cast("string"), "UNICODE"))
    return j.select(
        "board_id", "note_id", F.row_number().over(order).cast("long").alias("number"), "row", "column", C.color_name(F.col("color")).alias("color"), C.normalize_hex(F.col("color")).alias("color_hex"), "text"
    )


def _inside(px: np.ndarray, py: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """Points that no two sides of the quad see on different hands."""
    a, b = quad, np.roll(quad, -1, axis=0)
    cross = (b[:, 0] - a[:, 0])[:, None] * (py - a[:, 1][:, None]) - (b[:, 1] - a[:, 1])[:, None] * (px - a[:, 0][:, None])
    clear = np.abs(cross) >= 1e-5
    return ~(((cross > 0) & clear).any(0) & ((cross < 0) & clear).any(0))


def stacking(clusters: list[int], quads: list[np.ndarray], labels: np.ndarray) -> list[int]:
    """Layer of each proposal, the lowest 0: where two papers of different colours share an area, the colour seen there lies on top."""
    height, width = labels.shape
    score = np.zeros(len(quads), int)
    for i in range(len(quads)):
        for j in range(i + 1, len(quads)):
            if clusters[i] == clusters[j]:
                continue
            low = np.maximum(0, np.floor(np.maximum(quads[i].min(0), quads[j].min(0)))).astype(int)
            high = np.minimum([width - 1, height - 1], np.ceil(np.minimum(quads[i].max(0), quads[j].max(0)))).astype(int)
            if (low > high).any():
                continue
            step = max(1, int(np.sqrt(np.prod(high - low + 1)) / 54))
            ys, xs = np.mgrid[low[1] : high[1] + 1 : step, low[0] : high[0] + 1 : step]
            xs, ys = xs.ravel(), ys.ravel()
            shared = _inside(xs + 0.5, ys + 0.5, quads[i]) & _inside(xs + 0.5, ys + 0.5, quads[j])
            seen = labels[ys[shared], xs[shared]]
            mine, theirs = int((seen == clusters[i]).sum()), int((seen == clusters[j]).sum())
            if shared.sum() < 6 or mine + theirs < 4:
                continue
            vote = 1 if mine >= max(3, 1.22 * theirs) else -1 if theirs >= max(3, 1.22 * mine) else 0
            score[i] += vote
            score[j] -= vote
    layers = [0] * len(quads)
    for layer, i in enumerate(sorted(range(len(quads)), key=lambda i: (score[i], i))):
        layers[i] = layer
    return layers
