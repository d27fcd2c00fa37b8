"""Colour expressions: hex, RGB, Lab, palette and names. All are built-in columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinwall.functions.constants import PALETTE

DEFAULT_HEX = "#F7DC68"


def normalize_hex(color: Column, upper: bool = True, default: str = DEFAULT_HEX) -> Column:
    """#RRGGBB of a colour with 3 or 6 digits and perhaps a leading #; anything else (null too) is the default."""
    digits = F.regexp_replace(F.trim(color), "^#", "")
    doubled = F.regexp_replace(digits, "(.)", "$1$1")
    full = F.when(digits.rlike("^[0-9A-Fa-f]{3}$"), doubled).when(digits.rlike("^[0-9A-Fa-f]{6}$"), digits)
    out = F.concat(F.lit("#"), F.upper(full) if upper else full)
    return F.coalesce(out, F.lit(default))


def clean_hex(color: Column, fallback: str) -> Column:
    """Six upper-case digits without #, or the fallback."""
    digits = F.upper(F.substring(F.regexp_replace(color, "#", ""), 1, 6))
    return F.when(digits.rlike("^[0-9A-F]{6}$"), digits).otherwise(F.lit(fallback))


def channels(color: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of a six-digit colour, 0 to 255."""
    digits = F.regexp_replace(color, "#", "")
    return tuple(F.conv(F.substring(digits, 1 + 2 * i, 2), 16, 10).cast("double") for i in range(3))


def _linear(channel: Column) -> Column:
    v = channel / 255.0
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def _lab_of_linear(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """The cube-root scaled XYZ coordinates of linear channels."""

    def pivot(v: Column) -> Column:
        return F.when(v > 0.008856, F.cbrt(v)).otherwise(v * 7.787 + 16 / 116)

    x = pivot((r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047)
    y = pivot(r * 0.2126729 + g * 0.7151522 + b * 0.072175)
    z = pivot((r * 0.0193339 + g * 0.119192 + b * 0.9503041) / 1.08883)
    return x, y, z


def lab(red: Column, green: Column, blue: Column) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of sRGB channels as three expressions; with_lab shares their parts."""
    x, y, z = _lab_of_linear(_linear(red), _linear(green), _linear(blue))
    return y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0


def lab_of_hex(color: Column) -> tuple[Column, Column, Column]:
    return lab(*channels(color))


def lab_distance(left: tuple[Column, ...], right: tuple[Column, ...]) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(left, right)), F.lit(0.0)))


def with_lab(df: DataFrame, color: Column, names: tuple[str, ...] = ("l", "a", "b")) -> DataFrame:
    """df with the Lab coordinates of a six-digit colour. Columns are added step by step: one nested expression would repeat its parts."""
    df = df.withColumns({f"_{i}": c for i, c in enumerate(channels(color))})
    df = df.withColumns({f"_{i}": _linear(F.col(f"_{i}")) for i in range(3)})
    fx, fy, fz = _lab_of_linear(*(F.col(f"_{i}") for i in range(3)))
    return df.withColumns({"_fx": fx, "_fy": fy, "_fz": fz}).withColumns(
        {names[0]: F.col("_fy") * 116.0 - 16.0, names[1]: (F.col("_fx") - F.col("_fy")) * 500.0, names[2]: (F.col("_fy") - F.col("_fz")) * 200.0}
    ).drop("_0", "_1", "_2", "_fx", "_fy", "_fz")


def palette_distance(seen: tuple[Column, Column, Column], reference: tuple[float, float, float]) -> Column:
    """Distance of (lightness, chroma, hue) to a Lab colour; neutral paper and coloured paper are kept apart by 14."""
    light, chroma, hue = seen
    ref_chroma = math.hypot(reference[1], reference[2])
    turn = F.abs(hue - math.atan2(reference[2], reference[1]))
    # the sine of half the difference is the same for a difference and its complement to a full turn
    arc = F.sqrt(chroma * ref_chroma) * 2.0 * F.sin(turn / 2.0) * 1.08
    dl, dc = (light - reference[0]) * 0.30, (chroma - ref_chroma) * 0.52
    out = F.sqrt(dl * dl + dc * dc + arc * arc)
    if ref_chroma < 4:
        out = out + F.when(chroma >= 6, 14.0).otherwise(0.0)
    if ref_chroma >= 14:
        out = out + F.when(chroma < 4, 14.0).otherwise(0.0)
    return out


def py_lab(red: float, green: float, blue: float) -> tuple[float, float, float]:
    """lab() for plain numbers, for constants."""
    lin = [(v / 255) / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in (red, green, blue)]
    rows = ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.072175, 1.0), (0.0193339, 0.119192, 0.9503041, 1.08883))
    f = []
    for a, b, c, white in rows:
        v = (a * lin[0] + b * lin[1] + c * lin[2]) / white
        f.append(math.cbrt(v) if v > 0.008856 else 7.787 * v + 16 / 116)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def _rgb(digits: str) -> tuple[int, int, int]:
    return int(digits[:2], 16), int(digits[2:4], 16), int(digits[4:], 16)


def with_palette(df: DataFrame, names: tuple[str, ...] = ("l", "a", "b"), out: str = "ranking") -> DataFrame:
    """df with the palette ranked by distance from its Lab columns: array<struct<distance, ord, hex>>, the earlier entry first in a tie. No join: the palette is eight constants."""
    l, a, b = (F.col(n) for n in names)
    df = df.withColumns({"_chroma": F.sqrt(a * a + b * b), "_hue": F.atan2(b, a)})
    seen = (l, F.col("_chroma"), F.col("_hue"))
    entries = [F.struct(palette_distance(seen, py_lab(*_rgb(h))).alias("distance"), F.lit(i).alias("ord"), F.lit(f"#{h}").alias("hex")) for i, (h, _, _) in enumerate(PALETTE)]
    return df.withColumn(out, F.array_sort(F.array(*entries))).drop("_chroma", "_hue")


def color_name(color: Column) -> Column:
    """German name of the palette colour that is nearest in RGB."""
    r, g, b = channels(normalize_hex(color))
    entries = []
    for i, (h, _, name) in enumerate(PALETTE):
        x, y, z = _rgb(h)
        entries.append(F.struct(F.sqrt((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)).alias("d"), F.lit(i).alias("ord"), F.lit(name).alias("name")))
    return F.array_min(F.array(*entries))["name"]
