"""The ordered fold of evidence: readings arrive one by one, and what is dropped early stays dropped."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PER_NOTE, PER_LINE = 4, 2
_NO_KEY = {i: None for i in range(128) if not chr(i).isalnum()}


@lru_cache(maxsize=1 << 16)
def key_of(text: str) -> str:
    if text.isascii():
        return text.lower().translate(_NO_KEY)
    folded = unicodedata.normalize("NFKC", text).lower()
    return "".join(c for c in folded if unicodedata.category(c)[0] in "LN")


def measured(r: dict) -> bool:
    return r["variant"] != "selected" and "fusion" not in (r["variant"] or "")


def representative(r: dict) -> bool:
    return not measured(r) or "aggregate" in (r["variant"] or "")


def _kept(rows: list[dict], limit: int) -> list[dict]:
    """Distinct texts, each by its best entry (measured ones before others), representatives first, then by confidence; at most limit."""
    best: dict[str, dict] = {}
    for r in rows:
        old = best.get(k := key_of(r["text"]))
        if old is None or (measured(r), r["confidence"] if measured(r) == measured(old) else 0) > (measured(old), old["confidence"] if measured(r) == measured(old) else 0):
            best[k] = r
    return sorted(best.values(), key=lambda r: (not representative(r), -r["confidence"]))[:limit]


def _joined(rows: list[dict], incoming: dict) -> list[dict]:
    """rows with one more reading: a repeated one only raises its confidence."""
    same = ("scope", "line_index", "engine", "variant")
    key = key_of(incoming["text"])
    twin = next((i for i, r in enumerate(rows) if key_of(r["text"]) == key and all(r[c] == incoming[c] for c in same)), None)
    if twin is None:
        return [*rows, incoming]
    if incoming["confidence"] > rows[twin]["confidence"]:
        return [*rows[:twin], incoming, *rows[twin + 1 :]]
    return list(rows)


def fold(state: list[dict], incoming: dict) -> list[dict]:
    """state with one more reading: a repeated one only raises its confidence; then per reader PER_NOTE note readings and per line PER_LINE stay."""
    rows = _joined(state, incoming)
    groups: dict[tuple, list[dict]] = {}
    order = [r for r in rows if r["scope"] == "note"], [r for r in rows if r["scope"] == "line"]
    # notes by reader, then lines by line and reader, each in order of first appearance
    for r in order[0]:
        groups.setdefault(("note", r["engine"]), []).append(r)
    lines = list(dict.fromkeys(-1 if r["line_index"] is None else r["line_index"] for r in order[1]))
    for i in lines:
        for r in order[1]:
            if (-1 if r["line_index"] is None else r["line_index"]) == i:
                groups.setdefault((i, r["engine"]), []).append(r)
    return [r for k, g in groups.items() for r in _kept(g, PER_NOTE if k[0] == "note" else PER_LINE)]


SCHEMA = "board_id long, note_id long, place long, seq long, engine string, variant string, scope string, line_index int, text string, confidence long"


def as_rows(state: list[dict]) -> list[dict]:
    return [r | {"place": i} for i, r in enumerate(state)]


class Folded:
    """The state that fold gives for a note's readings one after another; a reading only touches its own reader's, or line's and reader's, group."""

    def __init__(self):
        self.notes: dict[str | None, list[dict]] = {}
        self.lines: dict[int, dict[str | None, list[dict]]] = {}

    def add(self, r: dict) -> None:
        if r["scope"] == "note":
            groups, limit = self.notes, PER_NOTE
        elif r["scope"] == "line":
            groups, limit = self.lines.setdefault(-1 if r["line_index"] is None else r["line_index"], {}), PER_LINE
        else:
            return
        groups[r["engine"]] = _kept(_joined(groups.get(r["engine"], []), r), limit)

    def state(self) -> list[dict]:
        return [r for groups in (self.notes, *self.lines.values()) for g in groups.values() for r in g]


_COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[k]) for n, k in (c.split() for c in SCHEMA.split(", "))])


def _values(column: pa.Array) -> list:
    """to_pylist, quicker for numbers without nulls and for repeated strings."""
    if pa.types.is_integer(column.type) and not column.null_count:
        return column.to_numpy().tolist()
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        words = [*coded.dictionary.to_pylist(), None]
        return [words[i] for i in coded.indices.fill_null(-1).to_numpy().tolist()]
    return column.to_pylist()


def _folded_batches(batches: Iterator[pa.RecordBatch], size: int = 8192) -> Iterator[pa.RecordBatch]:
    """Rows in order of note and seq: the retained readings of each note."""
    note, held, out = None, Folded(), []
    names = [c for c in _COLUMNS if c != "place"]
    for batch in batches:
        for values in zip(*(_values(batch.column(c)) for c in names)):
            if values[:2] != note:
                out += as_rows(held.state())
                note, held = values[:2], Folded()
                if len(out) >= size:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)
                    out = []
            r = dict(zip(names, values))
            if (r["text"] or "").strip():
                held.add(r)
    yield pa.RecordBatch.from_pylist(out + as_rows(held.state()), _ARROW)


def fold_evidence(evidence: DataFrame) -> DataFrame:
    """The retained readings of each note after all of its evidence, in order of seq; exact for any variants.

    Notes stream through sorted partitions, many to a task; what is held is the retained readings of one.
    """
    rows = evidence.select(*(c for c in _COLUMNS if c != "place"))
    rows = rows.repartition("board_id", "note_id").sortWithinPartitions("board_id", "note_id", F.col("seq").asc_nulls_last())
    return rows.mapInArrow(_folded_batches, SCHEMA)
