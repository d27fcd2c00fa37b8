"""Fusion of a note's readings: lines that independent readers agree on, copied verbatim."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import DataFrame

from pinwall.functions.constants import PROTECTED_TERMS, SHORT_LABELS
from pinwall.functions.similarity import line_key, similarity

_WORD = regex.compile(r"[\p{L}][\p{L}'’-]*")
_NOISE = regex.compile(r"[^\p{L}\p{N}\s.,:;!?()/&+%#@-]")
_SOLID = regex.compile(r"[\p{L}\p{N}]")
_VOWEL = regex.compile(r"[aeiouyäöü]")
GAP, LINK = -0.9, 0.25


def bounded(x: float, low: float, high: float) -> float:
    return min(high, max(low, x))


@dataclass
class Reading:
    """A whole-note reading and what is derived from its text once."""

    engine: str
    variant: str
    text: str
    confidence: float
    lines: list[str] = field(init=False)

    def __post_init__(self):
        rows = self.text.replace("\r", "").split("\n")
        squeezed = (regex.sub(r"[ \t]+", " ", r).strip() for r in rows)
        self.lines = [r for r in squeezed if _SOLID.search(r)]
        self.words = _WORD.findall(self.text)
        self.key = line_key(self.text)


@dataclass(frozen=True)
class Context:
    """What the picture lets expect of the text; None where nothing does."""

    lines: int | None = None
    characters: int | None = None


def assess(r: Reading, known, context: Context = Context()) -> float:
    """0 to 1: known words, enough lines and characters, little noise. known tells whether the lexicon has a word."""
    if not r.lines or not r.words:
        return 0.0
    lower = [w.lower() for w in r.words]
    share = lambda test: sum(map(test, lower)) / len(lower)
    n = len(r.key)
    wanted = max(1, context.characters if context.characters is not None else min(8, max(4, n)))
    rows = max(1, context.lines if context.lines is not None else len(r.lines))
    gains = 0.26 + 0.2 * share(known) + 0.2 * bounded(n / wanted, 0, 1) + 0.1 * bounded(len(r.lines) / rows, 0, 1)
    gains += 0.08 * bounded(r.confidence, 0, 100) / 100 + 0.12 * bounded(n / 8, 0, 1)
    losses = 0.24 * share(lambda w: len(w) <= 2 and w not in SHORT_LABELS) + 0.16 * share(lambda w: len(w) >= 5 and not _VOWEL.search(w))
    losses += 0.45 * len(_NOISE.findall(r.text)) / max(1, len(r.text))
    return bounded(gains - losses, 0, 1)


def line_merit(line: str, confidence: float, known) -> float:
    """What a line is worth by itself; a dictionary word is a soft hint only."""
    words = _WORD.findall(line)
    if not words:
        return -8.0
    noise = len(_NOISE.findall(line)) / max(1, len(line))
    return 0.38 * sum(map(known, words)) / len(words) - 2.6 * noise + 0.1 * bounded(confidence, 0, 100) / 100 + 0.035 * min(len(words), 6)


def best_similarity(text: str, others) -> float:
    return max((similarity(text, o) for o in others), default=0.0)


def per_engine(readings: list[Reading], known, context: Context) -> list[Reading]:
    """One reading for each reader, in order of first appearance."""
    usable = [r for r in readings if r.lines]
    if not usable:
        return []
    seen = Context(
        context.lines if context.lines is not None else max(len(r.lines) for r in usable),
        context.characters if context.characters is not None else max(1, *(len(r.key) for r in usable)),
    )

    def merit(r: Reading) -> float:
        same = best_similarity(r.text, (o.text for o in usable if o is not r and o.engine == r.engine))
        crossed = best_similarity(r.text, (o.text for o in usable if o.engine != r.engine))
        fill = bounded(len(r.key) / max(1, seen.characters), 0, 1)
        return 2.4 * assess(r, known, seen) + 0.55 * same + 2 * crossed + 0.06 * min(len(r.lines), 6) + 0.16 * fill

    engines = dict.fromkeys(r.engine for r in usable)
    return [max((r for r in usable if r.engine == e), key=merit) for e in engines]


def align(anchor: list[str], other: list[str]) -> dict[int, str]:
    """Line of other for each anchor line, by global alignment: similar lines pair up, all else are gaps."""
    score = {(0, 0): 0.0}
    step: dict[tuple[int, int], tuple[int, int]] = {}
    for i in range(len(anchor) + 1):
        for j in range(len(other) + 1):
            if not i and not j:
                continue
            ways = []
            if i and j and (s := similarity(anchor[i - 1], other[j - 1])) >= LINK:
                ways.append((score[i - 1, j - 1] + 3 * s - 1, (i - 1, j - 1)))
            if i:
                ways.append((score[i - 1, j] + GAP, (i - 1, j)))
            if j:
                ways.append((score[i, j - 1] + GAP, (i, j - 1)))
            # the first of equals: pair, then skip in the anchor, then in the other
            score[i, j], step[i, j] = max(ways, key=lambda w: w[0])
    at, pairs = (len(anchor), len(other)), {}
    while at != (0, 0):
        to = step[at]
        if to[0] < at[0] and to[1] < at[1]:
            pairs[to[0]] = other[to[1]]
        at = to
    return pairs


def _anchor(usable: list[Reading], known, context: Context) -> Reading:
    def merit(r: Reading) -> float:
        peers = [(o.engine != r.engine, line) for o in usable if o is not r for line in o.lines]
        total = 3 * assess(r, known, context) + 0.04 * min(len(r.lines), context.lines if context.lines is not None else len(r.lines))
        for line in r.lines:
            total += line_merit(line, r.confidence, known) + 1.2 * best_similarity(line, (p for _, p in peers)) + 0.7 * best_similarity(line, (p for x, p in peers if x))
        return total

    scores = [merit(r) for r in usable]
    best = 0
    for i in range(1, len(usable)):
        lead = scores[i] - scores[best]
        if lead > 0.001 or abs(lead) <= 0.001 and len(usable[i].lines) > len(usable[best].lines):
            best = i
    return usable[best]


def fuse(readings: list[Reading], known, context: Context = Context()) -> dict | None:
    """The fused reading of one note, or None if no reading has a usable line. Every output line is some reader's own."""
    usable = per_engine(readings, known, context)
    for r in usable:
        r.confidence = bounded(r.confidence, 0, 100)
    if not usable:
        return None
    anchor = _anchor(usable, known, context)
    slots: list[list[tuple[Reading, str]]] = [[(anchor, line)] for line in anchor.lines]
    for r in usable:
        if r is not anchor:
            pairs = align(anchor.lines, r.lines)
            if not pairs and len(r.lines) == len(anchor.lines):
                pairs = dict(enumerate(r.lines))
            for i, line in pairs.items():
                slots[i].append((r, line))

    def merit(slot, option) -> float:
        r, line = option
        peers = [o for o in slot if o is not option]
        mean = sum(similarity(line, p) for _, p in peers) / len(peers) if peers else 0.0
        crossed = best_similarity(line, (p for o, p in peers if o.engine != r.engine))
        return line_merit(line, r.confidence, known) + 1.8 * assess(r, known, context) + 1.4 * mean + 0.75 * crossed

    chosen = [max(slot, key=lambda o, slot=slot: merit(slot, o)) for slot in slots]

    def stands(slot, option) -> bool:
        """A single character needs another reader's word for it."""
        r, line = option
        key = line_key(line)
        return len(key) != 1 or key in SHORT_LABELS or any(o.engine != r.engine and similarity(line, p) >= 0.8 for o, p in slot)

    kept = [i for i, o in enumerate(chosen) if stands(slots[i], o)] or list(range(len(chosen)))
    lines = [chosen[i] for i in kept]
    text = "\n".join(line for _, line in lines).strip()
    if not text:
        return None
    agreement = sum(best_similarity(chosen[i][1], (p for o, p in slots[i] if o is not chosen[i][0])) for i in kept) / len(kept)
    raw = sum(r.confidence for r, _ in lines) / len(lines)
    quality = sum(assess(r, known, context) for r, _ in lines) / len(lines)
    support = len({r.engine for r in usable if any(similarity(line, mine) >= 0.35 for _, line in lines for mine in r.lines)})
    if support >= 2 and agreement >= 0.6:
        sure = bounded(38 + 38 * agreement + 18 * quality, 35, 96)
    else:
        sure = bounded(18 + 48 * quality + 0.18 * raw, 15, 82)
    engines = {r.engine for r, _ in lines}
    return {
        "text": text,
        "confidence": int(sure + 0.5),
        "engine": lines[0][0].engine if len(engines) == 1 else anchor.engine,
        "variant": "cross-engine-fusion" if len(engines) > 1 else "variant-fusion",
        "agreement": agreement,
        "supporting_engines": support,
        "quality": quality,
        "needs_review": support < 2 or agreement < 0.55 or quality < 0.62,
    }


SCHEMA = "board_id long, note_id long, text string, confidence long, engine string, variant string, agreement double, supporting_engines long, quality double, needs_review boolean"


def fuse_notes(evidence: DataFrame, lexicon: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """One fused row for each note that has a usable whole-note reading.

    The words that the lexicon has among a board's readings are joined to the evidence first, so
    a kernel gets its board's words only; a board is one group of tens of notes.
    """
    from pyspark.sql import functions as F

    from pinwall.functions import text as T

    whole = evidence.where("scope = 'note'")
    words = whole.select("board_id", F.explode(T.words(F.col("text"))).alias("w"))
    forms = words.select("board_id", F.explode(F.array("w", F.lower("w"))).alias("word")).distinct()
    known = forms.join(lexicon.select("word").distinct(), "word").groupBy("board_id").agg(F.collect_set("word").alias("known"))
    rows = whole.join(known.hint("merge"), "board_id", "left")
    if context is not None:
        rows = rows.join(context, ["board_id", "note_id"], "left")
    else:
        rows = rows.withColumn("expected_lines", F.lit(None).cast("int")).withColumn("expected_chars", F.lit(None).cast("int"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        first = g["known"].iloc[0]
        have = frozenset([*(first if first is not None else ()), *PROTECTED_TERMS])
        out = []
        for note, rows in g.sort_values("seq").groupby("note_id", sort=True):
            lines, chars = rows["expected_lines"].iloc[0], rows["expected_chars"].iloc[0]
            seen = Context(None if pd.isna(lines) else int(lines), None if pd.isna(chars) else int(chars))
            readings = [Reading(r.engine, r.variant, r.text, r.confidence) for r in rows.itertuples()]
            if made := fuse(readings, lambda w: w in have or w.lower() in have, seen):
                out.append({"board_id": g["board_id"].iloc[0], "note_id": note} | made)
        return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.groupBy("board_id").applyInPandas(run, SCHEMA)
