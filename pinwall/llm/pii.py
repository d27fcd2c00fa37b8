"""PII: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.llm import common

#: Kinds in the order in which spans with one start are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "tel")
BASE = KINDS[:4]

# The four base patterns in equivalent forms without repeated scans: a run that fails from its
# first character fails from the others too, as what must follow the run stays the same.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Spans that the method adds: a proposal needs its checksum, or a score of at least MIN_SCORE.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")

#: Words that raise the score of a kind when they stand within WINDOW characters of the span.
CONTEXT = {
    "email": ("email", "mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "tel": ("phone", "tel", "call", "mobile", "fax", "telefon"),
}
WINDOW = 48
#: Score without context; a context word adds BONUS.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "tel": 0.3}
BONUS = 0.2
MIN_SCORE = 0.5
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four characters go last, letters count from 10, the remainder is 1."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            floor = m.end()
        # a local part never holds an @, so later ones can't reach back beyond this one
        floor = max(floor, at + 1)
        at = text.find("@", floor)
    return found


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") < 256


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """(start, end) in code points for each base kind; a match that fails its check is dropped without another try."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        found["email"] = _emails(text)
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW])}
    return min(1.0, PRIOR[kind] + BONUS * any(w in near for w in CONTEXT[kind]))


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """All spans as (start, end, kind, score), by start and then kind. Base spans stay whatever their score."""
    base = base_spans(text)
    out = [(s, e, k, score(text, k, s, e)) for k in BASE for s, e in base[k]]

    def free(s: int, e: int) -> bool:
        """Base spans of one kind never overlap, so the last one that starts before e tells for its kind."""
        return not any((i := bisect_left(base[k], (e,))) and base[k][i - 1][1] > s for k in BASE)

    if _DIGIT.search(text):
        more = [(m.start(), m.end(), "iban", score(text, "iban", *m.span())) for m in _IBAN.finditer(text) if mod97(m[0])]
        more += [(m.start(), m.end(), "ssn", score(text, "ssn", *m.span())) for m in _SSN.finditer(text)]
        more += [(m.start(), m.end(), "tel", score(text, "tel", *m.span())) for m in _TEL.finditer(text)]
        out += [x for x in more if x[3] >= MIN_SCORE and free(x[0], x[1])]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _joined(found: list[tuple[int, int, str, float]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k, _ in found)


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and found: every span of every whole text as array<struct<kind, start, end, score>>.

    Null counts as empty; texts without spans have an empty array. Each row is treated on its
    own, so repeated rows repeat their result. Offsets are code points, the end exclusive.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def make():
        def each(cols):
            return {
                "key": cols["key"],
                "found": [[{"kind": k, "start": s, "end": e, "score": w} for s, e, k, w in spans(t or "")] for t in cols["text"]],
            }

        return each

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return common.over_rows(
        rows, "key long, found array<struct<kind:string,start:long,end:long,score:double>>", pa.schema([("key", pa.int64()), ("found", kind)]), make
    ).withColumnRenamed("key", key)


def redact(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans give one replacement."""
    if text is None:
        return None
    out, at = [], 0
    for s, e, k, _ in spans(text):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
            at = e
    return "".join(out) + text[at:]


def op6_pii(spark, sf_dir):
    """Counts, digest and list of the spans of `documents`."""
    found = find_pii(common.table(spark, sf_dir, "documents"))

    def joined(of):
        return F.array_join(F.transform(of, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *(count(k) for k in BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda x: F.round(x["score"], 3).cast("string")), ",").alias("scores"),
    )
