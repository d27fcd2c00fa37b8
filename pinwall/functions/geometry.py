"""Geometry expressions over quads (array<struct<x, y>>, corners in order) and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinwall.functions.text import clamp


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    return F.sqrt(dx * dx + dy * dy)


def quad_to_board(quad: Column, width: Column, height: Column) -> Column:
    """struct<x, y, width, height, rotation>: an upright box in percent of the photo and its turn in degrees (0 below 0.08)."""
    tl, tr, br, bl = (quad[i] for i in range(4))
    w, h = F.greatest(F.lit(1.0), width), F.greatest(F.lit(1.0), height)
    box_w = clamp((distance(tl, tr) + distance(bl, br)) / 2.0 / w * 100.0, 0.6, 100.0)
    box_h = clamp((distance(tl, bl) + distance(tr, br)) / 2.0 / h * 100.0, 0.6, 100.0)
    cx = (tl["x"] + tr["x"] + br["x"] + bl["x"]) / 4.0 / w * 100.0
    cy = (tl["y"] + tr["y"] + br["y"] + bl["y"]) / 4.0 / h * 100.0
    turn = F.degrees(F.atan2(tr["y"] - tl["y"], tr["x"] - tl["x"]))
    turn = F.when(F.abs(turn) < 0.08, 0.0).otherwise(turn)
    return F.struct((cx - box_w / 2.0).alias("x"), (cy - box_h / 2.0).alias("y"), box_w.alias("width"), box_h.alias("height"), turn.alias("rotation"))


def signed_area(polygon: Column) -> Column:
    """Shoelace sum of a polygon; positive if y grows downwards and corners run clockwise."""
    following = F.concat(F.slice(polygon, 2, F.size(polygon) - 1), F.slice(polygon, 1, 1))
    terms = F.zip_with(polygon, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2.0


def area(polygon: Column) -> Column:
    return F.abs(signed_area(polygon))


def inside(quad: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a convex quad: no two sides see it on different hands (sides it lies on don't count)."""
    following = F.concat(F.slice(quad, 2, 3), F.slice(quad, 1, 1))
    cross = F.zip_with(quad, following, lambda a, b: (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]))
    clear = F.filter(cross, lambda c: F.abs(c) >= 1e-5)
    return ~(F.exists(clear, lambda c: c > 0) & F.exists(clear, lambda c: c < 0))


def project(quad: Column, u: Column, v: Column) -> Column:
    """Where the homography of the unit square onto the quad sends (u, v); affine if opposite sides are parallel."""
    p0, p1, p2, p3 = (quad[i] for i in range(4))
    sx, sy = p0["x"] - p1["x"] + p2["x"] - p3["x"], p0["y"] - p1["y"] + p2["y"] - p3["y"]
    dx1, dy1, dx2, dy2 = p1["x"] - p2["x"], p1["y"] - p2["y"], p3["x"] - p2["x"], p3["y"] - p2["y"]
    det = dx1 * dy2 - dx2 * dy1
    affine = ((F.abs(sx) < 1e-9) & (F.abs(sy) < 1e-9)) | (F.abs(det) < 1e-9)
    g = F.when(affine, 0.0).otherwise((sx * dy2 - dx2 * sy) / det)
    h = F.when(affine, 0.0).otherwise((dx1 * sy - sx * dy1) / det)
    w = g * u + h * v + 1.0

    def axis(n: str) -> Column:
        return ((p1[n] - p0[n] + g * p1[n]) * u + (p3[n] - p0[n] + h * p3[n]) * v + p0[n]) / w

    return F.struct(axis("x").alias("x"), axis("y").alias("y"))


def overlap(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(hi1, hi2) - F.greatest(lo1, lo2))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes given as x, y, width, height."""
    both = overlap(a["x"], a["x"] + a["width"], b["x"], b["x"] + b["width"]) * overlap(a["y"], a["y"] + a["height"], b["y"], b["y"] + b["height"])
    return both / F.greatest(F.lit(1e-9), a["width"] * a["height"] + b["width"] * b["height"] - both)


def quarter_turn_difference(a: Column, b: Column) -> Column:
    """Difference of two angles in degrees when a quarter turn doesn't count: 0 to 45."""
    d = F.pmod(F.abs(a - b), F.lit(90.0))
    return F.least(d, 90.0 - d)


def curve(sx: Column, sy: Column, tx: Column, ty: Column) -> Column:
    """struct of the control points of the arrow between two centres."""
    bend = F.greatest(F.lit(5.0), F.abs(tx - sx) * 0.32)
    return F.struct(sx.alias("x0"), sy.alias("y0"), (sx + bend).alias("x1"), sy.alias("y1"), (tx - bend).alias("x2"), ty.alias("y2"), tx.alias("x3"), ty.alias("y3"))
