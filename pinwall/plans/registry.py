"""All queries of the note-board engine by name, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pinwall.plans import boards, kernels, readings

_ALL = {**boards.PAIRS, **readings.PAIRS, **kernels.PAIRS}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for k, (q, _) in _ALL.items()}
ORACLE: dict[str, str] = {k: s for k, (_, s) in _ALL.items() if s}
