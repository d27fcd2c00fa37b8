"""Text expressions over readings. All are built-in columns; NFKC, which Spark lacks, is in functions.similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pinwall.functions.constants import SHORT_LABELS

#: Words of a reading (fusion) begin with a letter; words for correction may begin with a digit.
WORD = r"[\p{L}][\p{L}'’-]*"
WORD_OR_NUMBER = r"[\p{L}\p{N}][\p{L}\p{N}'’-]*"
#: What the fusion and the quality score take for noise (the score doesn't know # and @).
JUNK = r"[^\p{L}\p{N}\s.,:;!?()/&+%#@-]"
QUALITY_JUNK = r"[^\p{L}\p{N}\s.,:;!?()/&+%-]"


def js_round(x: Column) -> Column:
    """Halves go up, as floor(x + 0.5); Spark's round sends negative halves down."""
    return F.floor(x + 0.5)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def clean_text(text: Column) -> Column:
    """Runs of bars are an I; blanks are squeezed, lines trimmed, at most one empty line kept."""
    out = F.regexp_replace(text, r"[|]{2,}", "I")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def normalized_line(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def normalized_text(text: Column) -> Column:
    """Lower case, one space for all that is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def usable_lines(text: Column) -> Column:
    """Squeezed, trimmed lines that hold a letter or digit."""
    lines = F.split(F.regexp_replace(text, "\r", ""), "\n")
    lines = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}]"))


def similarity(left: Column, right: Column) -> Column:
    """key_similarity of the normalized lines. In joins, normalize before them."""
    return key_similarity(normalized_line(left), normalized_line(right))


def key_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein / longer length; 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longest)


def text_agreement(left: Column, right: Column) -> Column:
    """Percent, rounded, with words kept apart by spaces."""
    a, b = normalized_text(left), normalized_text(right)
    longest = F.greatest(F.lit(1), F.length(a), F.length(b))
    return clamp(js_round((F.lit(1.0) - F.levenshtein(a, b) / longest) * 100.0), 0, 100)


def completeness(text: Column, final: Column) -> Column:
    """Percent of the final text's length that a reading has, at most 100."""
    share = F.length(normalized_text(text)) / F.greatest(F.lit(1), F.length(normalized_text(final)))
    return js_round(clamp(share * 100.0, 0.0, 100.0))


def text_quality(text: Column, confidence: Column) -> Column:
    """Confidence, raised by useful characters, lowered by noise, runs of one character and many lines; -100 for no text."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    useful = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]"))
    junk = F.regexp_count(t, F.lit(QUALITY_JUNK)) / F.greatest(F.lit(1), F.length(t))
    runs = F.when(t.rlike(r"(.)\1{4,}"), 16.0).otherwise(0.0)
    lines = F.greatest(F.lit(0), F.size(F.split(t, "\n")) - 6) * 7.0
    full = confidence + F.least(F.lit(12.0), useful * 0.28) - junk * 65.0 - runs - lines
    return F.when(F.length(t) == 0, -100.0).when(useful < 2, confidence * 0.25 - 30.0).otherwise(full)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_fragment(word: Column) -> Column:
    return (F.length(word) <= 2) & ~F.lower(word).isin(*SHORT_LABELS)


def lexical_plausibility(word_list: Column, known: Column) -> Column:
    """Share of known words, less 0.45 of the share of fragments; known: array of the text's words that the lexicon has."""
    n = F.size(word_list)
    fragments = F.size(F.filter(word_list, is_fragment))
    return F.when(n == 0, 0.0).otherwise(clamp(F.size(known) / n - fragments / n * 0.45, 0.0, 1.0))


def assess(text: Column, confidence: Column, n_known: Column, expected_lines: Column, expected_chars: Column) -> Column:
    """0 to 1: how plausible a reading is; n_known is the number of its words that the lexicon has."""
    lines, found = F.size(usable_lines(text)), words(text)
    n = F.size(found)
    chars = F.length(normalized_line(text))
    junk = F.regexp_count(text, F.lit(JUNK)) / F.greatest(F.lit(1), F.length(text))
    short = F.size(F.filter(found, is_fragment)) / n
    mute = F.size(F.filter(found, lambda w: (F.length(w) >= 5) & ~F.lower(w).rlike("[aeiouyäöü]"))) / n
    chars_wanted = F.greatest(F.lit(1), F.coalesce(expected_chars, F.least(F.lit(8), F.greatest(F.lit(4), chars))))
    lines_wanted = F.greatest(F.lit(1), F.coalesce(expected_lines, lines))
    gained = F.lit(0.26) + n_known / n * 0.2 + clamp(chars / chars_wanted, 0.0, 1.0) * 0.2 + clamp(lines / lines_wanted, 0.0, 1.0) * 0.1
    gained = gained + clamp(confidence, 0.0, 100.0) / 100.0 * 0.08 + clamp(chars / 8.0, 0.0, 1.0) * 0.12
    return F.when((lines == 0) | (n == 0), 0.0).otherwise(clamp(gained - short * 0.24 - mute * 0.16 - junk * 0.45, 0.0, 1.0))
