"""Symbols in drawn masks, their fusion and how they join texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinwall.operators import symbols as S
from pinwall.operators import symbols_text as X

H, W = 100, 120


def line(m, x0, y0, x1, y1, r=2.0):
    ys, xs = np.mgrid[: m.shape[0], : m.shape[1]]
    d = np.array([x1 - x0, y1 - y0], float)
    t = np.clip(((xs - x0) * d[0] + (ys - y0) * d[1]) / max(1e-9, d @ d), 0, 1)
    m[(xs - x0 - t * d[0]) ** 2 + (ys - y0 - t * d[1]) ** 2 <= r * r] = 1


def blank():
    return np.zeros((H, W), np.uint8)


def arrow(dx, dy):
    m = blank()
    cx, cy = 60, 50
    tip = (cx + 28 * dx, cy + 28 * dy)
    line(m, cx - 28 * dx, cy - 28 * dy, *tip)
    for s in (-1, 1):
        line(m, *tip, tip[0] - 14 * dx + s * 11 * dy, tip[1] - 14 * dy + s * 11 * dx)
    return m


def heart():
    m = blank()
    t = np.linspace(0, 2 * np.pi, 90)
    p = np.stack([60 + 1.9 * 16 * np.sin(t) ** 3 * 0.9, 48 - 1.7 * (13 * np.cos(t) - 7 * np.cos(2 * t) - 2 * np.cos(3 * t) - np.cos(4 * t))], 1)
    for a, b in zip(p, p[1:]):
        line(m, *a, *b, 1.8)
    return m


def ring_face(smile):
    m = blank()
    t = np.linspace(0, 2 * np.pi, 90)
    for a, b in zip(t, t[1:]):
        line(m, 60 + 34 * np.cos(a), 50 + 34 * np.sin(a), 60 + 34 * np.cos(b), 50 + 34 * np.sin(b), 1.6)
    for x in (48, 72):
        line(m, x, 40, x, 40, 3)
    xs = np.linspace(-14, 14, 15)
    ys = 64 + (1 if smile else -1) * (6 - 12 * (xs / 14) ** 2) / 2
    for i in range(14):
        line(m, 60 + xs[i], ys[i], 60 + xs[i + 1], ys[i + 1], 1.4)
    return m


def mark():
    m = blank()
    line(m, 60, 20, 60, 60, 3)
    line(m, 60, 76, 60, 76, 3.5)
    return m


@pytest.mark.parametrize("mask, want", [(arrow(1, 0), "→"), (arrow(-1, 0), "←"), (arrow(0, -1), "↑"), (arrow(0, 1), "↓"), (heart(), "♥"), (mark(), "!"), (ring_face(True), "☺"), (ring_face(False), "☹")])
def test_symbols_are_read(mask, want):
    assert [s["symbol"] for s in S.recognize(mask)] == [want]


def test_letters_and_bars_are_not():
    h, i, bars = blank(), blank(), blank()
    line(h, 45, 25, 45, 75)
    line(h, 75, 25, 75, 75)
    line(h, 45, 50, 75, 50)
    line(i, 60, 25, 60, 75)
    line(bars, 40, 20, 40, 80)
    line(bars, 80, 20, 80, 80)
    for m in (h, i, bars, blank()):
        assert S.recognize(m) == []


def _symbol(symbol, sure, x, ink=0.5):
    return {"symbol": symbol, "label": symbol, "confidence": sure, "dominant_ink": ink, "x": x, "y": 0.2, "width": 0.3, "height": 0.3}


def test_fusion_needs_agreement():
    assert S.fuse_sets([[_symbol("♥", 95, 0.1)], [_symbol("♥", 90, 0.11)]])[0]["symbol"] == "♥"
    assert S.fuse_sets([[_symbol("♥", 95, 0.1)], [_symbol("!", 90, 0.1)]]) == []
    assert S.fuse_sets([[_symbol("♥", 95, 0.1)], [_symbol("♥", 90, 0.6)]]) == []
    lone = S.fuse_sets([[_symbol("♥", 96, 0.1, 0.9)], []])
    assert lone[0]["confidence"] == 89


def test_symbols_join_text(spark):
    rows = [("go on", ["→"], "go on\n→"), ("go → on", ["→"], "go → on"), ("", ["♥", "!"], "♥ !"), ("a ! b", ["!", "→", "!"], "a ! b\n! →"), (" x ", [], "x")]
    df = spark.createDataFrame(rows, "text string, symbols array<string>, want string")
    assert df.select(X.merge(F.col("text"), F.col("symbols")).alias("g"), "want").where("not g <=> want").collect() == []
    kind = "text string, symbols array<struct<symbol:string,confidence:int,dominant_ink:double>>, want string"
    rows = [("1 1", [("♥", 90, 0.8)], "♥"), ("11", [("♥", 80, 0.8)], "11\n♥"), ("V", [("♥", 90, 0.8)], "♥"), ("Vogel", [("♥", 90, 0.8)], "Vogel\n♥"), ("11", [("♥", 90, 0.8), ("!", 90, 0.1)], "11\n♥ !")]
    df = spark.createDataFrame(rows, kind)
    assert df.select(X.reconcile(F.col("text"), F.col("symbols")).alias("g"), "want").where("not g <=> want").collect() == []
    df = spark.createDataFrame([("", "♥", "♥"), ("a", "♥", "a ♥"), ("a ", "♥", "a ♥")], "text string, s string, want string")
    assert df.where(X.append_manual(F.col("text"), F.col("s")) != F.col("want")).count() == 0
