"""Greedy CTC decoding of step matrices, as a vectorised column function and natively."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

STRIDE, BLANK = 4, 0


def valid_steps(width: int, stride: int = STRIDE) -> int:
    return math.ceil(width / stride)


def decode(logits: np.ndarray, alphabet: str, steps: int | None = None) -> tuple[str, int]:
    """(text, confidence): the best class of each step, repeats and blanks dropped; the mean softmax peak of the written characters in percent."""
    m = np.asarray(logits, float)[:steps]
    if not len(m):
        return "", 0
    best = m.argmax(1)
    write = (best != BLANK) & np.concatenate([[True], best[1:] != best[:-1]])
    if not write.any():
        return "", 0
    peak = 1 / np.exp(m - m.max(1, keepdims=True)).sum(1)
    return "".join(alphabet[c - 1] for c in best[write] if c <= len(alphabet)), int(100 * peak[write].mean() + 0.5)


def best_classes(flat: Column, classes: int) -> Column:
    """Best class (from 0; the first of equals) of each step of a flat array of steps x classes."""
    steps = F.floor(F.size(flat) / classes).cast("int")
    rows = F.transform(F.sequence(F.lit(0), steps - 1), lambda s: F.slice(flat, s * classes + 1, F.lit(classes)))
    return F.when(steps > 0, F.transform(rows, lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def written(classes: Column) -> Column:
    """Classes that are written: neither blank nor the same as the step before."""
    return F.filter(classes, lambda c, i: (c != BLANK) & ((i == 0) | (c != F.get(classes, i - 1))))


def text_of(classes: Column, alphabet: str) -> Column:
    return F.array_join(F.transform(written(classes), lambda c: F.substring(F.lit(alphabet), c, F.lit(1))), "")
