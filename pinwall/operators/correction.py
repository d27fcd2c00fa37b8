"""Conservative correction: choose among what readers saw, then repair single words that a lexicon vouches for."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pinwall.functions import text as T
from pinwall.functions.constants import PROTECTED_TERMS
from pinwall.functions.similarity import comparable, digit_variants, osa, osa_distance, ocr_distance, reading_cost, text_similarity
from pinwall.operators import vocabulary as V
from pinwall.operators.fusion import bounded

_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}'’\-]*")
_NOISE = regex.compile(r"[^\p{L}\p{N}\s.,:;!?()\-/&+%#@]")
#: Suggestions for a word from each language's lexicon.
SUGGESTIONS = 12


# ---------------------------------------------------------------- suggestions


def _deletions(word, depth: int = 2):
    """The word and what is left after deleting one or two characters, as an array column."""

    def once(words):
        return F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substr(w, i + 1)))))

    one = once(F.array(word))
    return F.array_distinct(F.concat(F.array(word), one, once(one) if depth > 1 else F.array()))


def suggestions(words: DataFrame, lexicons: DataFrame) -> DataFrame:
    """word, lang, suggestion, rank (from 0) for each distinct word (lower case): lexicon words within two edits and two letters of length.

    Two words within two edits share a string that is left after at most two deletions in each;
    that is an equi-join, whatever the lexicon's size. Nearer in reading cost ranks first, then
    the alphabet.
    """
    left = words.select("word").distinct().select("word", F.explode(_deletions(F.col("word"))).alias("k"))
    right = lexicons.select("lang", F.col("word").alias("suggestion")).distinct().select("lang", "suggestion", F.explode(_deletions(F.col("suggestion"))).alias("k"))
    pairs = left.join(right, "k").select("word", "lang", "suggestion").distinct().where((F.abs(F.length("word") - F.length("suggestion")) <= 2) & (F.col("word") != F.col("suggestion")))
    near = pairs.withColumn("edits", osa_distance("word", "suggestion")).where("edits <= 2").withColumn("cost", ocr_distance("word", "suggestion"))
    order = Window.partitionBy("word", "lang").orderBy("cost", "suggestion")
    return near.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < SUGGESTIONS).select("word", "lang", "suggestion", "rank", "edits")


# ---------------------------------------------------------------- one board


class Board:
    """What is known on one board: lexicon words by language, suggestions by word, its own vocabulary and language."""

    def __init__(self, known: dict[str, frozenset[str]], suggested: dict[str, dict[str, list[str]]], own: set[str], preferred: str | None):
        self.known, self.suggested, self.preferred = known, suggested, preferred
        self.own = set(PROTECTED_TERMS) | own

    def in_lexicon(self, word: str) -> bool:
        return any(w in words for words in self.known.values() for w in (word, word.lower()))

    def candidates(self, word: str) -> list[str]:
        """The board's own near words, then the lexicons' suggestions, the preferred language first; one spelling each."""
        low = word.lower()
        reach = 3 if len(word) >= 8 else 2
        out = [t for t in (*PROTECTED_TERMS, *sorted(self.own - set(PROTECTED_TERMS))) if abs(len(t) - len(word)) <= 2 and osa(word, t) <= reach and reading_cost(word, t) <= max(1.25, 0.22 * len(word))]
        langs = sorted(("de", "en"), key=lambda g: g != (self.preferred or "de"))
        for g in langs:
            out += self.suggested.get(low, {}).get(g, [])
        return list({s.lower(): s for s in out}.values())

    def cost(self, word: str, suggestion: str, rank: int) -> float:
        low = suggestion.lower()
        bonus = 0.85 if low in PROTECTED_TERMS else 0.55 if low in self.own else 0.0
        same_start = 0.4 if word[:1].lower() == low[:1] else 0.0
        return 0.76 * reading_cost(word, suggestion) + 0.24 * osa(word, suggestion) + 0.08 * abs(len(word) - len(suggestion)) + 0.025 * rank - same_start - bonus

    def caps_rescue(self, word: str) -> str | None:
        """The one word that an unknown word in capitals, of five letters or more, misses by one edit at its ends or in place."""
        low = word.lower()
        if len(word) < 5 or not all_caps(word) or self.in_lexicon(word):
            return None
        ranked = []
        for rank, s in enumerate(self.candidates(word)):
            t = s.lower()
            # two neighbours swapped are likelier another word than a misreading
            swapped = len(t) == len(low) and sorted(t) == sorted(low) and sum(x != y for x, y in zip(t, low)) == 2 and osa(t, low) == 1
            if not swapped and (t.startswith(low) or t.endswith(low) or len(t) == len(low)):
                foreign = 0.65 if self.preferred and not {s, t} & self.known.get(self.preferred, frozenset()) else 0.0
                ranked.append((self.cost(word, s, rank) + foreign, len(ranked), s))
        ranked.sort()
        if not ranked or osa(word, ranked[0][2]) != 1 or reading_cost(word, ranked[0][2]) / len(word) > 0.18:
            return None
        return None if len(ranked) > 1 and ranked[1][0] - ranked[0][0] < 0.04 else ranked[0][2]


def all_caps(word: str) -> bool:
    return len(word) > 1 and word == word.upper()


def caps_like(word: str) -> bool:
    """In capitals, or framed by them with at least half of its letters."""
    letters = [c for c in word if c.isalpha()]
    high = sum(c == c.upper() for c in letters)
    return len(letters) > 1 and (all_caps(word) or word[0].isupper() and word[-1].isupper() and 2 * high >= len(letters))


def dressed(like: str, word: str) -> str:
    if caps_like(like):
        return word.upper()
    return word[:1].upper() + word[1:].lower() if like[:1].isupper() else word.lower()


def correct_text(raw: str, board: Board) -> tuple[str, list[dict]]:
    """The text with single words repaired, and what was changed: from, to, start, end (in raw), kind."""
    out, changes, at = [], [], 0
    whole_caps = all_caps(regex.sub(r"[^\p{L}]", "", raw))
    for m in _WORD.finditer(raw):
        made = _corrected(m[0], board, whole_caps)
        if made and made[0] != m[0]:
            out += [raw[at : m.start()], made[0]]
            at = m.end()
            changes.append({"from": m[0], "to": made[0], "start": m.start(), "end": m.end(), "kind": made[1], "automatic": True})
    return "".join(out) + raw[at:], changes


def _corrected(word: str, board: Board, whole_caps: bool) -> tuple[str, str] | None:
    low = word.lower()
    digits, letters = any(c.isdigit() for c in word), any(c.isalpha() for c in word)
    confusable = letters and any(c in "0158" for c in word)
    if low in board.own or board.in_lexicon(word) and not (digits and letters):
        # only the case may be wrong
        inner = word[1:]
        mixed = any(c.islower() for c in inner) and any(c.isupper() for c in inner)
        if mixed and (low in PROTECTED_TERMS or any(low in w for w in board.known.values())):
            return (low.upper() if caps_like(word) or whole_caps else low[:1].upper() + low[1:] if word[0].isupper() else low), "case"
        return None
    if digits and not confusable:
        return None
    if confusable:
        fits = {v.lower(): v for v in digit_variants(word) if v.lower() in board.own or any(v.lower() in w for w in board.known.values())}
        return (dressed(word, next(iter(fits.values()))), "rescue") if len(fits) == 1 else None
    ranked = sorted((board.cost(word, s, i), i, s) for i, s in enumerate(board.candidates(word)))
    if not ranked:
        return None
    best = ranked[0][2]
    lead = ranked[1][0] - ranked[0][0] if len(ranked) > 1 else float("inf")
    cost, edits, target = reading_cost(word, best), osa(word, best), best.lower()
    clear = lead >= (0.28 if target in board.own else 0.5)
    guarded = len(ranked) < 2 or ranked[1][2].lower() not in PROTECTED_TERMS or lead >= 0.18
    caps = caps_like(word)
    domain = target in board.own and (caps or cost <= 0.72) and (caps or edits > 1 or cost <= 0.3)
    domain = domain and edits <= (3 if len(word) >= 8 else 2 if len(word) >= 6 else 1) and cost / len(word) <= 0.2
    domain = domain and (clear or target in PROTECTED_TERMS and caps and (guarded or cost <= 0.9))
    rescue = board.caps_rescue(word)
    if not domain and not rescue:
        return None
    made = dressed(word, rescue or best)
    return (made, "rescue") if made.lower() != low else None


def choose_observed(primary: dict, others: list[dict], board: Board) -> dict:
    """The primary reading, or another that two readers confirm or that is clearly more plausible and cross-checked."""
    rows, seen = [], set()
    for r in (primary, *(o for o in others if o["scope"] == "note")):
        k = (comparable(r["text"]), r["engine"], r["variant"], r["scope"])
        if r["text"].strip() and k not in seen:
            seen.add(k)
            rows.append(r)
    if len(rows) < 2:
        return primary
    groups: dict[str, list[dict]] = {}
    for r in rows:
        groups.setdefault(comparable(r["text"]), []).append(r)
    votes = []
    for text, g in groups.items():
        own = [r for r in g if r["variant"] != "selected" and "fusion" not in (r["variant"] or "")] or g
        sources = {(r["engine"], r["variant"] or "default") for r in own}
        mean = sum(bounded(r["confidence"], 0, 100) for r in own) / len(own)
        votes.append(((len({e for e, _ in sources}), len(sources), mean), text, max(g, key=lambda r: r["confidence"])))
    votes.sort(key=lambda v: v[0], reverse=True)
    (engines, sources, _), text, pick = votes[0]
    if engines >= 2 and (len(votes) < 2 or (engines, sources) > votes[1][0][:2]) and text != comparable(primary["text"]):
        return pick

    def crossed(r: dict) -> float:
        return max((text_similarity(r["text"], o["text"]) for o in rows if o["engine"] != r["engine"]), default=0.0)

    def merit(r: dict) -> float:
        words = _WORD.findall(r["text"])
        share = lambda test: sum(map(test, words)) / len(words) if words else 0.0
        total = 0.45 * share(lambda w: w.lower() in board.own or board.in_lexicon(w)) + 0.65 * share(lambda w: board.caps_rescue(w) is not None)
        total += 0.45 * share(lambda w: w.lower() in board.own) + 1.75 * crossed(r) + 0.3 * bounded(r["confidence"], 0, 100) / 100
        return total - 2.2 * len(_NOISE.findall(r["text"])) / max(1, len(r["text"]))

    winner = max(rows, key=merit)
    margin = 0.01 if any(board.caps_rescue(w) for w in _WORD.findall(winner["text"])) else 0.45
    return winner if winner is not primary and merit(winner) - merit(primary) >= margin and crossed(winner) >= 0.55 else primary


SCHEMA = "board_id long, note_id long, raw_text string, text string, confidence long, corrections array<struct<from:string,to:string,start:int,end:int,kind:string,automatic:boolean>>"


def near_lexicon(seen: DataFrame, found: DataFrame) -> DataFrame:
    """board_id, word of unknown words within one edit of one of their first eight suggestions."""
    near = found.where("rank < 8 and edits <= 1").select("word").distinct()
    return seen.join(near, "word", "left_semi").select("board_id", "word")


def correct_notes(notes: DataFrame, evidence: DataFrame, lexicons: DataFrame) -> DataFrame:
    """raw_text, text, confidence and corrections of every note; notes: board_id, note_id, text, confidence, engine.

    Lexicons (lang, word in lower case) meet the boards' words in joins only; a kernel gets what
    its board needs. Offsets refer to the text chosen among the readings, which raw_text need
    not be. A note without evidence is corrected by its own words.
    """
    own_rows = notes.select("board_id", "note_id", F.coalesce("engine", F.lit("paddle")).alias("engine"), F.lit("selected").alias("variant"), F.lit("note").alias("scope"), "text")
    readings = own_rows.unionByName(evidence.where("scope = 'note'").select(*own_rows.columns))
    words = V.board_words(readings, "board_id").select("board_id", F.lower("word").alias("word")).distinct()
    forms = words.withColumn("variant", F.explode(F.array("word", *(F.translate("word", "0158", t) for t in ("oisb", "olsb")))))
    hits = forms.select("board_id", F.col("variant").alias("word")).distinct().join(lexicons.select("lang", "word").distinct(), "word")
    known = hits.groupBy("board_id").agg(F.collect_set(F.struct("lang", "word")).alias("known"))
    unknown = words.join(lexicons.select("word").distinct(), "word", "left_anti")
    found = suggestions(unknown, lexicons)
    offered = unknown.join(found, "word").groupBy("board_id").agg(F.collect_list(F.struct("word", "lang", "rank", "suggestion")).alias("offered"))
    # words that are suggested are known, too
    seen = V.vocabulary_evidence(readings, lexicons)
    own = V.board_vocabulary(seen, near_lexicon(seen, found)).groupBy("board_id").agg(F.collect_set("word").alias("own"))
    language = V.language_preference(notes.select("board_id", "text"), lexicons).select("board_id", "preferred")
    rows = notes.select("board_id", "note_id", F.lit(-1).cast("long").alias("seq"), F.coalesce("engine", F.lit("paddle")).alias("engine"), F.lit("selected").alias("variant"), F.lit("primary").alias("scope"), F.coalesce("text", F.lit("")).alias("text"), F.col("confidence").cast("long").alias("confidence"))
    rows = rows.unionByName(evidence.select("board_id", "note_id", "seq", "engine", "variant", "scope", "text", F.col("confidence").cast("long").alias("confidence")))
    facts = language.join(known, "board_id", "left").join(offered, "board_id", "left").join(own, "board_id", "left")

    # a new name, so that the two sides of the cogroup share no column
    facts = facts.select(F.col("board_id").alias("facts_of"), "preferred", "known", "offered", "own")

    def run(key, g: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        lists = facts.iloc[0].to_dict() if len(facts) else {}
        get = lambda c: lists[c] if lists.get(c) is not None and not isinstance(lists.get(c), float) else []
        by_lang: dict[str, set] = {"de": set(), "en": set()}
        for k in get("known"):
            by_lang.setdefault(k["lang"], set()).add(k["word"])
        offers: dict[str, dict[str, list]] = {}
        for o in sorted(get("offered"), key=lambda o: (o["word"], o["lang"], o["rank"])):
            offers.setdefault(o["word"], {}).setdefault(o["lang"], []).append(o["suggestion"])
            by_lang.setdefault(o["lang"], set()).add(o["suggestion"])
        b = Board({k: frozenset(v) for k, v in by_lang.items()}, offers, set(get("own")), lists.get("preferred"))
        out = []
        for note, rows in g.sort_values("seq").groupby("note_id"):
            records = rows.to_dict("records")
            primary = next((r for r in records if r["scope"] == "primary"), None)
            if primary is None:
                continue
            primary = primary | {"scope": "note", "text": unicodedata.normalize("NFC", primary["text"])}
            picked = choose_observed(primary, [r for r in records if r["scope"] == "note"], b)
            text, changes = correct_text(unicodedata.normalize("NFC", picked["text"]), b)
            replaced = picked["text"] != primary["text"]
            if replaced:
                changes = [{"from": primary["text"], "to": picked["text"], "start": 0, "end": len(primary["text"]), "kind": "rescue", "automatic": True}, *changes]
            sure = min(82 if replaced else 99, max(0, picked["confidence"] - 4 * len(changes)))
            out.append((key[0], note, primary["text"], text, sure, changes))
        return pd.DataFrame(out, columns=["board_id", "note_id", "raw_text", "text", "confidence", "corrections"])

    return rows.groupBy("board_id").cogroup(facts.groupBy("facts_of")).applyInPandas(run, SCHEMA)


def assemble(notes: DataFrame, selected: DataFrame) -> DataFrame:
    """Final rows of all notes: the selected reading cleaned, confidence 1 to 99; notes without one are empty with engine "none" and confidence 0."""
    j = notes.select("board_id", "note_id").join(selected, ["board_id", "note_id"], "left")
    has = F.coalesce(F.length("text") > 0, F.lit(False))
    return j.select(
        "board_id",
        "note_id",
        F.when(has, T.clean_text(F.col("text"))).otherwise(F.lit("")).alias("text"),
        F.when(has, F.least(F.greatest(F.floor(F.col("confidence") + 0.5), F.lit(1)), F.lit(99))).otherwise(F.lit(0)).cast("long").alias("confidence"),
        F.when(has, F.col("engine")).otherwise(F.lit("none")).alias("engine"),
    )
