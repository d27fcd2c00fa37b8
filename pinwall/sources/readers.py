"""Readers: what turns crops into evidence. Models plug in by the protocol; the simulated reader needs none."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.functions import text as T
from pinwall.operators import ctc
from pinwall.operators import evidence as E
from pinwall.operators import fusion

SCHEMA = "board_id long, note_id long, seq long, engine string, variant string, scope string, line_index int, text string, confidence long, status string, error string"


class Reader(Protocol):
    """Reads crops (board_id, note_id, variant, line_index, width, height, data) into evidence rows with status and error."""

    engine: str

    def read(self, crops: DataFrame) -> DataFrame: ...


class FunctionReader:
    """A reader from a function of one crop: image -> (text, confidence). load() is called once a task, so a model is loaded there and not shipped.

    A crop that fails gives a row with status "failed" and the error; the others go on.
    """

    def __init__(self, engine: str, load: Callable[[], Callable[[np.ndarray], tuple[str, float]]]):
        self.engine, self.load = engine, load

    def read(self, crops: DataFrame) -> DataFrame:
        engine, load = self.engine, self.load
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def run(frames):
            model = load()
            for g in frames:
                out = []
                for r in g.itertuples():
                    scope, line = ("note", None) if pd.isna(r.line_index) else ("line", int(r.line_index))
                    row = [r.board_id, r.note_id, r.seq, engine, f"{engine}-{r.variant}", scope, line]
                    try:
                        text, sure = model(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1))
                        out.append((*row, text, int(np.floor(min(100.0, max(0.0, sure)) + 0.5)), "ready", None))
                    except Exception as e:  # a model may fail in any way on one image
                        out.append((*row, "", 0, "failed", f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=names).astype({"line_index": "Int32"})

        return crops.mapInPandas(run, SCHEMA)


class CtcReader(FunctionReader):
    """A line reader from a function of a luminance tensor to step logits."""

    def __init__(self, engine: str, load: Callable[[], Callable[[np.ndarray], np.ndarray]], alphabet: str):
        def wrapped():
            from pinwall.operators.crops import line_tensor

            model = load()

            def one(image: np.ndarray) -> tuple[str, float]:
                x = line_tensor(np.repeat(image, 3, -1) if image.shape[-1] == 1 else image)
                return ctc.decode(model(x), alphabet, ctc.valid_steps(x.shape[1]))

            return one

        super().__init__(engine, wrapped)


class SimulatedReaders:
    """Three deterministic misreadings of known texts, for tests and demonstrations."""

    engine = "simulated"

    def read(self, notes: DataFrame) -> DataFrame:
        return E.simulate(notes)


def accept(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evidence, failures): cleaned, non-blank readings with rounded, bounded confidence; and the rows that failed."""
    good = readings.where("status = 'ready'").withColumn("text", T.clean_text(F.col("text"))).where("trim(text) <> ''")
    return good.drop("status", "error"), readings.where("status <> 'ready'").select("board_id", "note_id", "engine", "error")


def group_items(items: DataFrame) -> DataFrame:
    """Detected items of a crop as text: items join rows by vertical overlap, rows run top to bottom, items left to right.

    items: board_id, note_id, variant, item, poly (array<struct<x, y>>), text, score (0 to 1);
    the confidence is the score's mean weighted by text length.
    """
    box = lambda f, c: f(F.transform("poly", lambda p: p[c]))
    rows = items.withColumn("clean", T.clean_text(F.col("text"))).where((F.col("clean") != "") & (F.size("poly") >= 3))
    rows = rows.select("board_id", "note_id", "variant", "item", "clean", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)).alias("score"), box(F.array_min, "x").alias("x"), box(F.array_min, "y").alias("top"), box(F.array_max, "y").alias("low"))

    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.assign(mid=(g.top + g.low) / 2, tall=np.maximum(1, g.low - g.top)).sort_values(["mid", "x", "item"], kind="stable")
        lines: list[dict] = []
        for it in g.itertuples():
            fits = []
            for n, r in enumerate(lines):
                least = min(max(1, r["low"] - r["top"]), it.tall)
                shared = max(0, min(r["low"], it.low) - max(r["top"], it.top)) / max(1, least)
                off = abs(r["mid"] - it.mid)
                if shared >= 0.3 or off <= max(8, 0.55 * least):
                    fits.append((off, n))
            if fits:
                r = lines[min(fits)[1]]
                r["items"].append(it)
                r["top"], r["low"] = min(r["top"], it.top), max(r["low"], it.low)
                r["mid"] = sum(i.mid for i in r["items"]) / len(r["items"])
            else:
                lines.append({"items": [it], "top": it.top, "low": it.low, "mid": it.mid})
        text = "\n".join(" ".join(i.clean.replace("\n", " ") for i in sorted(r["items"], key=lambda i: i.x)) for r in sorted(lines, key=lambda r: r["mid"]))
        weight = np.maximum(1, g.clean.str.len())
        return pd.DataFrame({"board_id": [key[0]], "note_id": [key[1]], "variant": [key[2]], "text": [text], "confidence": [int(100 * (g.score * weight).sum() / weight.sum() + 0.5)]})

    return rows.groupBy("board_id", "note_id", "variant").applyInPandas(run, "board_id long, note_id long, variant string, text string, confidence long")


def cascade(first: DataFrame, more: list[Callable[[DataFrame], DataFrame]], lexicon: DataFrame) -> DataFrame:
    """Evidence from readers in turn: each next one reads only the notes (board_id, note_id) whose fused reading is still weak after those before. A reader may return several variants, which are judged together."""
    evidence = first
    for read in more:
        weak = E.weak_notes(evidence, fusion.fuse_notes(evidence, lexicon)).where("weak").select(*E.NOTE)
        evidence = evidence.unionByName(read(weak))
    return evidence
