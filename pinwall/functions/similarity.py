"""Text measures that Spark has no expression for: NFKC, edit distances with swaps, and reading costs.

Plain functions for kernels, and vectorised column functions for tables.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, IntegerType, StringType

from pinwall.functions.constants import CONFUSION_COSTS, DIGIT_LETTERS, MERGE_COSTS

_COST = {pair: cost for key, cost in CONFUSION_COSTS.items() for pair in (key, key[::-1])}
_MERGE = [(a, b, cost) for pair, cost in MERGE_COSTS.items() for a, b in (pair, pair[::-1])]
_REACH = max(2, *(len(a) for a, _, _ in _MERGE))


@lru_cache(maxsize=1 << 16)
def line_key(text: str) -> str:
    """Lower case, letters and digits only."""
    return "".join(c for c in text.lower() if unicodedata.category(c)[0] in "LN")


def comparable(text: str) -> str:
    """NFKC, lower case, single spaces between runs of letters and digits."""
    folded = unicodedata.normalize("NFKC", text).lower()
    return " ".join("".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded).split())


@lru_cache(maxsize=1 << 16)
def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def similarity(a: str, b: str) -> float:
    """1 - edit distance / longer length of the line keys; 0 if one is empty."""
    a, b = line_key(a), line_key(b)
    return 1 - levenshtein(a, b) / max(len(a), len(b)) if a and b else 0.0


@lru_cache(maxsize=1 << 16)
def osa(a: str, b: str) -> int:
    """Optimal string alignment in lower case: swapping neighbours costs 1, and no place is edited twice."""
    a, b = a.lower(), b.lower()
    before, last = [], list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        now = [i]
        for j in range(1, len(b) + 1):
            best = min(last[j] + 1, now[-1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                best = min(best, before[j - 2] + 1)
            now.append(best)
        before, last = last, now
    return last[-1]


def text_similarity(a: str, b: str) -> float:
    """Like similarity, over NFKC and with swaps."""
    a, b = comparable(a).replace(" ", ""), comparable(b).replace(" ", "")
    return 1 - osa(a, b) / max(len(a), len(b)) if a and b else 0.0


@lru_cache(maxsize=1 << 16)
def reading_cost(a: str, b: str) -> float:
    """How dearly a reader would take a for b: confusable characters, swaps and merged pairs are cheap."""
    a, b = (unicodedata.normalize("NFKC", s).lower() for s in (a, b))

    # rows of the table, the last as many as a way may reach back; now[j] is the cost of the first i characters of a against the first j of b
    rows: list[list[float]] = []
    for i in range(len(a) + 1):
        now: list[float] = []
        for j in range(len(b) + 1):
            ways = [] if i or j else [0.0]
            if i:
                ways.append(rows[-1][j] + 0.85)
            if j:
                ways.append(now[j - 1] + 0.85)
            if i and j:
                x, y = a[i - 1], b[j - 1]
                ways.append(rows[-1][j - 1] + (0.0 if x == y else _COST.get(x + y, 1.0)))
            if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1]:
                ways.append(rows[-2][j - 2] + 0.45)
            for x, y, c in _MERGE:
                if a.endswith(x, 0, i) and b.endswith(y, 0, j):
                    ways.append(rows[-len(x)][j - len(y)] + c)
            now.append(min(ways))
        rows = [*rows, now][-_REACH:]
    return rows[-1][-1]


def digit_variants(word: str, limit: int = 32) -> list[str]:
    """The word with digits read as the letters they may stand for, itself left out; at most `limit` kept at every step."""
    out = [""]
    for c in word:
        out = [head + x for head in out for x in c + DIGIT_LETTERS.get(c, "")][:limit]
    return out[1:]


def quad_clip(subject: list[tuple[float, float]], window: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon inside a convex one."""
    hand = 1 if _signed(window) >= 0 else -1
    out = subject
    for (ax, ay), (bx, by) in zip(window, window[1:] + window[:1]):
        depth = [hand * ((bx - ax) * (y - ay) - (by - ay) * (x - ax)) for x, y in out]
        cut = []
        for k, (p, d) in enumerate(zip(out, depth)):
            q, e = out[k - 1], depth[k - 1]
            if (d >= 0) != (e >= 0):
                t = e / (e - d)
                cut.append((q[0] + (p[0] - q[0]) * t, q[1] + (p[1] - q[1]) * t))
            if d >= 0:
                cut.append(p)
        out = cut
    return out


def _signed(p: list[tuple[float, float]]) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1])) / 2


def quad_shares(a: list[tuple[float, float]], b: list[tuple[float, float]]) -> tuple[float, float]:
    """(intersection over union, intersection over the smaller area) of two quads."""
    both = abs(_signed(quad_clip(a, b)))
    x, y = abs(_signed(a)), abs(_signed(b))
    return both / max(1e-9, x + y - both), both / max(1e-9, min(x, y))


def _pairwise(kind: DataType, f):
    @F.pandas_udf(kind)
    def column(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)])

    return column


osa_distance = _pairwise(IntegerType(), osa)
ocr_distance = _pairwise(DoubleType(), reading_cost)
nfkc_similarity = _pairwise(DoubleType(), text_similarity)


def _points(q) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in q]


quad_iou = _pairwise(DoubleType(), lambda a, b: quad_shares(_points(a), _points(b))[0])
quad_containment = _pairwise(DoubleType(), lambda a, b: quad_shares(_points(a), _points(b))[1])


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def folded(text: Column) -> Column:
    """NFKC of a text; what is ASCII, and so its own normal form, isn't sent to Python."""
    return F.coalesce(nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-])*")
WORD_OR_NUMBER = re.compile(r"[^\W_](?:[^\W_]|['’-])*")
