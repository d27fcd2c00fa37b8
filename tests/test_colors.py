"""Colours: palette classes under exposure, names, hex forms."""

import pytest
from pyspark.sql import functions as F

from pinwall.functions import color as C


@pytest.mark.parametrize(
    "rgb, want",
    [((247, 220, 104), "#f7dc68"), ((200, 176, 80), "#f7dc68"), ((252, 232, 140), "#f7dc68"), ((215, 140, 156), "#f2a3b4"), ((140, 185, 206), "#a9d9ee"), ((160, 198, 140), "#b9dfa5"), ((180, 160, 212), "#cdb8ee"), ((225, 160, 88), "#f2b46d"), ((214, 216, 219), "#d6d8db")],
)
def test_nearest_palette_survives_exposure(spark, rgb, want):
    df = spark.createDataFrame([("#%02x%02x%02x" % rgb,)], "color string")
    assert C.with_palette(C.with_lab(df, F.col("color"))).first().ranking[0].hex == want


def test_lab_forms_agree(spark):
    df = spark.createDataFrame([("#4080c0",), ("#000000",), ("#ffffff",)], "color string")
    rows = C.with_lab(df, F.col("color")).select("color", "l", "a", "b", *(c.alias(f"e{i}") for i, c in enumerate(C.lab_of_hex(F.col("color"))))).collect()
    for r in rows:
        want = C.py_lab(*(int(r.color[i : i + 2], 16) for i in (1, 3, 5)))
        assert (r.l, r.a, r.b) == pytest.approx(want) == (r.e0, r.e1, r.e2)


def test_hex_forms(spark):
    rows = [("#abc", "#AABBCC", "FFFFFF"), (" F7dc68 ", "#F7DC68", "FFFFFF"), ("#12345", "#F7DC68", "FFFFFF"), (None, "#F7DC68", "FFFFFF"), ("#a1b2c3", "#A1B2C3", "A1B2C3")]
    df = spark.createDataFrame([r[:1] for r in rows], "c string")
    got = df.select(C.normalize_hex(F.col("c")).alias("n"), C.clean_hex(F.col("c"), "FFFFFF").alias("s")).collect()
    assert [g.n for g in got] == [r[1] for r in rows] and got[4].s == "A1B2C3" and got[3].s == "FFFFFF"


def test_names(spark):
    df = spark.createDataFrame([("#f0dd70", "Gelb"), ("#d0d0d0", "Grau"), ("nonsense", "Gelb")], "c string, want string")
    assert df.where(C.color_name(F.col("c")) != F.col("want")).count() == 0
