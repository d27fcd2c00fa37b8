"""Queries over derived evidence and texts: cleaning, quality, votes, gates, retention."""

from __future__ import annotations


from pyspark.sql import functions as F

from pinwall.functions import text as T
from pinwall.operators import boards as B
from pinwall.operators import evidence as E
from pinwall.operators import vocabulary as V
from pinwall.functions.constants import PROTECTED_TERMS
from pinwall.operators import fusion
from pinwall.plans.bridge import EVIDENCE, LEXICON, NOTES, WIDE, evidence, lexicon, notes, simulated, table

_BASE = f"WITH {NOTES}, {EVIDENCE}"


def _r(df, *cols, places=4):
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in cols})


def _norm(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _words(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _fold(x: str) -> str:
    """NFKC of the derived readings: they have one letter that isn't its own form."""
    return f"replace({x}, '{WIDE}', 'a')"


def _one_byte(x: str) -> str:
    """DuckDB's levenshtein counts bytes: the letter that has more is written as a character that normalized texts don't have."""
    return f"replace({x}, '{WIDE}', '~')"


def _sim(a: str, b: str) -> str:
    a, b = _one_byte(_norm(a)), _one_byte(_norm(b))
    return f"CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(@T, '[|]{2,}', 'I', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', '\n', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')".replace("'\\n', 'g'), '\\n{3,}'", "chr(10), 'g'), '\\n{3,}'")
_LINES = r"list_filter(list_transform(string_split(replace(@T, chr(13), ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))"
# DuckDB's expressions have no back references: one alternative for each character that may repeat
_RUNS = "|".join(f"{c}{{5,}}" for c in (*"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789äöüßéèêçáíóúñ,;:!%&@#=<>_ -", *(f"\\{c}" for c in ".*+?|()[]{}$^/\"~`")))


def _quality(t: str, c: str) -> str:
    t = f"regexp_replace({t}, '^\\s+|\\s+$', '', 'g')"
    useful = f"len(regexp_extract_all({t}, '[\\p{{L}}\\p{{N}}]'))"
    junk = f"len(regexp_extract_all({t}, '[^\\p{{L}}\\p{{N}}\\s.,:;!?()/&+%-]'))::DOUBLE / greatest(1, length({t}))"
    full = f"{c} + least(12.0::DOUBLE, {useful} * 0.28::DOUBLE) - {junk} * 65 - CASE WHEN regexp_matches({t}, '{_RUNS}') THEN 16 ELSE 0 END - greatest(0, len(string_split({t}, chr(10))) - 6) * 7"
    return f"CASE WHEN length({t}) = 0 THEN -100.0 WHEN {useful} < 2 THEN {c} * 0.25::DOUBLE - 30 ELSE {full} END"


def clean_text(spark, sf):
    c = T.clean_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("hash"))


CLEAN_TEXT = f"SELECT doc_id, length(c) AS n, md5(c) AS hash FROM (SELECT doc_id, {_CLEAN.replace('@T', 'text')} AS c FROM documents)"


def usable_lines(spark, sf):
    u = T.usable_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(u).cast("long").alias("n"), F.md5(F.array_join(u, "\n")).alias("hash"))


USABLE_LINES = f"SELECT doc_id, len(u) AS n, md5(array_to_string(u, chr(10))) AS hash FROM (SELECT doc_id, {_LINES.replace('@T', 'text')} AS u FROM documents)"


def text_quality(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.text_quality(F.col("text"), F.col("doc_id") * 7 % 60 + 40).alias("quality"))
    return _r(d, "quality")


TEXT_QUALITY = f"SELECT doc_id, round({_quality('text', '(doc_id * 7 % 60 + 40)')}, 4) + 0.0 AS quality FROM documents"


def simulated_readers(spark, sf):
    return simulated(spark, sf).select("note_id", "engine", "text", F.col("confidence").cast("long").alias("confidence"))


SIMULATED_READERS = f"""WITH {NOTES}, r AS (SELECT note_id, text, confidence, unnest(['paddle', 'dehtr', 'tesseract']) AS engine FROM notes)
SELECT note_id, engine, CASE engine WHEN 'paddle' THEN CASE WHEN text ILIKE '%o%' THEN regexp_replace(text, '[oO]', '0') ELSE regexp_replace(text, '[iI]', 'l') END
 WHEN 'dehtr' THEN CASE WHEN text ILIKE '%rn%' THEN regexp_replace(text, '(?i)rn', 'm') ELSE regexp_replace(text, '\\s+', ' ', 'g') END
 ELSE CASE WHEN text ILIKE '%l%' THEN regexp_replace(text, '[lL]', '1') ELSE regexp_replace(text, '[sS]', '5') END END AS text,
 least(greatest(confidence + CASE engine WHEN 'paddle' THEN 5 WHEN 'dehtr' THEN -1 ELSE -8 END, 35), 94)::BIGINT AS confidence FROM r"""


def variant_similarity(spark, sf):
    return _r(E.pair_similarity(evidence(spark, sf)).drop("board_id"), "similarity")


VARIANT_SIMILARITY = _BASE + f" SELECT a.note_id, a.seq AS left_seq, b.seq AS right_seq, round({_sim('a.text', 'b.text')}, 4) AS similarity FROM evidence a JOIN evidence b ON a.note_id = b.note_id AND a.seq < b.seq"


def variant_matrix(spark, sf):
    return E.variant_matrix(evidence(spark, sf)).drop("board_id")


VARIANT_MATRIX = _BASE + """ SELECT note_id, engine, max(confidence) FILTER (variant LIKE '%-rgb') AS rgb, max(confidence) FILTER (variant LIKE '%contrast%') AS contrast, max(confidence) FILTER (variant LIKE '%gray%') AS gray,
 max(confidence) FILTER (variant LIKE '%sauvola%') AS sauvola, max(confidence) FILTER (variant LIKE '%-ink') AS ink, max(confidence) FILTER (variant LIKE '%line%') AS line FROM evidence GROUP BY note_id, engine"""


def reader_top2(spark, sf):
    return E.reader_top(evidence(spark, sf)).select("note_id", "engine", F.col("place").cast("long").alias("place"), "seq", "confidence")


READER_TOP2 = _BASE + ", r AS (SELECT *, row_number() OVER (PARTITION BY note_id, engine ORDER BY confidence DESC, seq) AS place FROM evidence) SELECT note_id, engine, place, seq, confidence FROM r WHERE place <= 2"


def evidence_retention(spark, sf):
    return E.retain(evidence(spark, sf)).select("note_id", "engine", "seq", "text", "confidence")


EVIDENCE_RETENTION = _BASE + f""", n AS (SELECT *, {_norm(_fold('text'))} AS norm FROM evidence), d AS (SELECT *, row_number() OVER (PARTITION BY note_id, engine, norm ORDER BY confidence DESC, seq) AS r FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY note_id, engine ORDER BY confidence DESC, seq) AS place FROM d WHERE r = 1) SELECT note_id, engine, seq, text, confidence FROM p WHERE place <= 4"""


def exact_vote(spark, sf):
    v = E.exact_vote(evidence(spark, sf)).select("note_id", "norm", "engines", "sources", "confidence", F.col("place").cast("long").alias("place"), "confirmed")
    return _r(v, "confidence")


EXACT_VOTE = _BASE + f""", g AS (SELECT note_id, {_words(_fold('text'))} AS norm, count(DISTINCT engine) AS engines, count(DISTINCT engine || ':' || variant) AS sources, avg(confidence) AS confidence, min(seq) AS seq FROM evidence GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS place, lead(engines) OVER w AS e2, lead(sources) OVER w AS s2 FROM g WINDOW w AS (PARTITION BY note_id ORDER BY engines DESC, sources DESC, confidence DESC, seq))
SELECT note_id, norm, engines, sources, round(confidence, 4) AS confidence, place, place = 1 AND engines >= 2 AND (e2 IS NULL OR engines > e2 OR (engines = e2 AND sources > s2)) AS confirmed FROM r"""

_ASSESS = (
    """k AS (SELECT note_id, seq, count(*) AS n_words, count(*) FILTER (l.word IS NOT NULL OR lower(e.w) IN (%t)) AS n_known FROM (SELECT note_id, seq, unnest(regexp_extract_all(text, '[\\p{L}][\\p{L}''’-]*')) AS w FROM evidence) e LEFT JOIN lexicon l ON lower(e.w) = l.word GROUP BY note_id, seq),
x AS (SELECT e.*, coalesce(n_words, 0) AS n, coalesce(n_known, 0) AS known, regexp_extract_all(text, '[\\p{L}][\\p{L}''’-]*') AS ws, len(%s) AS lines, length(%s) AS chars FROM evidence e LEFT JOIN k ON e.note_id = k.note_id AND e.seq = k.seq),
c AS (SELECT note_id, max(lines) AS el, max(greatest(1, chars)) AS ec FROM x WHERE lines > 0 GROUP BY note_id),
s AS (SELECT x.*, ec, CASE WHEN lines = 0 OR n = 0 THEN 0.0::DOUBLE ELSE least(greatest(0.26::DOUBLE + known::DOUBLE / n * 0.2 + least(chars::DOUBLE / ec, 1) * 0.2 + least(lines::DOUBLE / el, 1) * 0.1 + confidence / 100.0::DOUBLE * 0.08 + least(chars / 8.0::DOUBLE, 1) * 0.12
 - len(list_filter(ws, lambda w: length(w) <= 2 AND lower(w) NOT IN ('ai', 'api', 'hr', 'it', 'qa', 'ui', 'ux')))::DOUBLE / n * 0.24 - len(list_filter(ws, lambda w: length(w) >= 5 AND NOT regexp_matches(lower(w), '[aeiouyäöü]')))::DOUBLE / n * 0.16
 - len(regexp_extract_all(text, '[^\\p{L}\\p{N}\\s.,:;!?()/&+%%#@-]'))::DOUBLE / greatest(1, length(text)) * 0.45, 0), 1) END AS assessment FROM x JOIN c ON x.note_id = c.note_id)"""
    .replace("%%", "%")
    .replace("%t", ", ".join(f"'{t}'" for t in PROTECTED_TERMS))
    .replace("%s", _LINES.replace("@T", "text"), 1)
    .replace("%s", _norm("text"), 1)
)


def _context(e):
    return e.groupBy(*E.NOTE).agg(F.max(F.size(T.usable_lines(F.col("text")))).alias("expected_lines"), F.max(F.greatest(F.lit(1), F.length(T.normalized_line(F.col("text"))))).alias("expected_chars"))


def assess_text(spark, sf):
    e = evidence(spark, sf)
    return _r(E.assessed(e, lexicon(spark, sf), _context(e)).select("note_id", "seq", "n_words", "n_known", "assessment"), "assessment")


ASSESS_TEXT = _BASE + f", {LEXICON}, {_ASSESS} SELECT note_id, seq, n AS n_words, known AS n_known, round(assessment, 4) AS assessment FROM s"


def collapse_readers(spark, sf):
    return _r(E.collapse_readers(evidence(spark, sf), lexicon(spark, sf)).select("note_id", "engine", "seq", "score"), "score", places=6)


COLLAPSE_READERS = _BASE + f""", {LEXICON}, {_ASSESS}, m AS (SELECT a.note_id, a.seq, max(CASE WHEN a.engine = b.engine THEN {_sim('a.text', 'b.text')} END) AS same, max(CASE WHEN a.engine <> b.engine THEN {_sim('a.text', 'b.text')} END) AS crossed
 FROM evidence a JOIN evidence b ON a.note_id = b.note_id AND a.seq <> b.seq GROUP BY a.note_id, a.seq),
f AS (SELECT s.*, assessment * 2.4 + coalesce(same, 0) * 0.55 + coalesce(crossed, 0) * 2 + least(lines, 6) * 0.06 + least(chars::DOUBLE / ec, 1) * 0.16 AS score FROM s LEFT JOIN m ON s.note_id = m.note_id AND s.seq = m.seq WHERE lines > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY note_id, engine ORDER BY score DESC, seq) AS place FROM f) SELECT note_id, engine, seq, round(score, 6) AS score FROM r WHERE place = 1"""


# the fusion of one-line readings, as the derived ones are: one reading for each reader, one slot, no gaps
_FUSED = f"""{_ASSESS}, m AS (SELECT a.note_id, a.seq, max(CASE WHEN a.engine = b.engine THEN {_sim('a.text', 'b.text')} END) AS same, max(CASE WHEN a.engine <> b.engine THEN {_sim('a.text', 'b.text')} END) AS crossed
 FROM evidence a JOIN evidence b ON a.note_id = b.note_id AND a.seq <> b.seq GROUP BY a.note_id, a.seq),
f AS (SELECT s.*, assessment * 2.4 + coalesce(same, 0) * 0.55 + coalesce(crossed, 0) * 2 + least(lines, 6) * 0.06 + least(chars::DOUBLE / ec, 1) * 0.16 AS score FROM s LEFT JOIN m ON s.note_id = m.note_id AND s.seq = m.seq WHERE lines > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY note_id, engine ORDER BY score DESC, seq) AS place FROM f),
z AS (SELECT board_id, note_id, seq, engine, text, confidence, row_number() OVER (PARTITION BY note_id ORDER BY seq) - 1 AS i, len(regexp_extract_all(text, '[^\\p{{L}}\\p{{N}}\\s.,:;!?()/&+%#@-]'))::DOUBLE / greatest(1, length(text)) AS junk,
 len(list_filter(ws, lambda w: length(w) <= 2 AND lower(w) NOT IN ('ai', 'api', 'hr', 'it', 'qa', 'ui', 'ux')))::DOUBLE / n AS short, len(list_filter(ws, lambda w: length(w) >= 5 AND NOT regexp_matches(lower(w), '[aeiouyäöü]')))::DOUBLE / n AS mute,
 known::DOUBLE / n AS share, n, least(chars::DOUBLE / least(8, greatest(4, chars)), 1) AS fill, least(chars / 8.0::DOUBLE, 1) AS size FROM r WHERE place = 1),
u AS (SELECT *, least(greatest(0.26::DOUBLE + 0.2 * share + 0.2 * fill + 0.1 + 0.08 * confidence / 100.0::DOUBLE + 0.12 * size - (0.24 * short + 0.16 * mute + 0.45 * junk), 0), 1) AS a0,
 0.38::DOUBLE * share - 2.6 * junk + 0.1 * confidence / 100.0::DOUBLE + 0.035 * least(n, 6) AS worth FROM z),
q AS (SELECT a.note_id, a.i, max({_sim('a.text', 'b.text')}) AS best, avg({_sim('a.text', 'b.text')}) AS mean FROM u a JOIN u b ON a.note_id = b.note_id AND a.i <> b.i GROUP BY ALL),
o AS (SELECT u.*, best, 3 * a0 + 0.04 + worth + 1.2 * best + 0.7 * best AS doc, worth + 1.8 * a0 + 1.4 * mean + 0.75 * best AS merit FROM u JOIN q ON u.note_id = q.note_id AND u.i = q.i),
d AS (SELECT note_id, max(doc) FILTER (i = 0) AS s0, max(doc) FILTER (i = 1) AS s1, max(doc) FILTER (i = 2) AS s2 FROM o GROUP BY note_id),
h AS (SELECT note_id, CASE WHEN s2 - CASE WHEN s1 - s0 > 0.001 THEN s1 ELSE s0 END > 0.001 THEN 2 WHEN s1 - s0 > 0.001 THEN 1 ELSE 0 END AS anchor FROM d),
t AS (SELECT o.*, row_number() OVER (PARTITION BY o.note_id ORDER BY merit DESC, i <> anchor, i) AS place FROM o JOIN h ON o.note_id = h.note_id),
v AS (SELECT t.note_id, count(*) AS support FROM t JOIN u ON t.note_id = u.note_id AND {_sim('t.text', 'u.text')} >= 0.35 WHERE t.place = 1 GROUP BY t.note_id),
fused AS (SELECT t.board_id, t.note_id, t.text, floor(CASE WHEN support >= 2 AND best >= 0.6 THEN least(greatest(38 + 38 * best + 18 * a0, 35), 96) ELSE least(greatest(18 + 48 * a0 + 0.18 * confidence, 15), 82) END + 0.5)::BIGINT AS confidence,
 engine, 'variant-fusion' AS variant, best AS agreement, support AS supporting_engines, a0 AS quality, support < 2 OR best < 0.55 OR a0 < 0.62 AS needs_review FROM t JOIN v ON t.note_id = v.note_id WHERE t.place = 1)"""


def fuse_lines(spark, sf):
    return _r(fusion.fuse_notes(evidence(spark, sf), lexicon(spark, sf)), "agreement", "quality")


FUSE_LINES = _BASE + f", {LEXICON}, {_FUSED} SELECT * REPLACE (round(agreement, 4) AS agreement, round(quality, 4) AS quality) FROM fused"


def weak_gate(spark, sf):
    e = evidence(spark, sf)
    return _r(E.weak_notes(e, fusion.fuse_notes(e, lexicon(spark, sf))).select("note_id", "agreement", "quality", "confidence", "weak"), "agreement", "quality")


WEAK_GATE = _BASE + f""", {LEXICON}, {_FUSED}, p AS (SELECT a.note_id, max({_sim('a.text', 'b.text')}) AS pairs FROM evidence a JOIN evidence b ON a.note_id = b.note_id AND a.seq < b.seq GROUP BY a.note_id),
w AS (SELECT fused.note_id, pairs, confidence, {_quality('text', 'confidence')} AS judged FROM fused JOIN p ON fused.note_id = p.note_id)
SELECT note_id, round(pairs, 4) AS agreement, round(judged, 4) AS quality, confidence, pairs < 0.62 OR judged < 62 OR (confidence < 74 AND pairs < 0.86) AS weak FROM w"""


def stability(spark, sf):
    e = evidence(spark, sf)
    return _r(E.stability(e, fusion.fuse_notes(e, lexicon(spark, sf))).drop("board_id"), "stability")


STABILITY = _BASE + f", {LEXICON}, {_FUSED} SELECT fused.note_id, round(max({_sim('fused.text', 'e.text')}), 4) AS stability FROM fused JOIN evidence e ON fused.note_id = e.note_id GROUP BY fused.note_id"


def visual_context(spark, sf):
    k = F.col("l_partkey")
    bands = table(spark, sf, "lineitem").select(F.floor(k / 20).alias("board_id"), k.alias("note_id"), (F.col("l_quantity") * 4).alias("width"), (F.col("l_linenumber") * 3.0).alias("height"))
    return E.visual_context(notes(spark, sf), bands.where("note_id % 10 > 0"))


VISUAL_CONTEXT = f"""WITH {NOTES}, b AS (SELECT l_partkey AS note_id, count(*) AS n, sum(least(greatest(l_quantity * 4 / greatest(1, l_linenumber * 3) * 2.2::DOUBLE, 2), 18)) AS chars FROM lineitem WHERE l_partkey % 10 > 0 GROUP BY l_partkey)
SELECT board_id, notes.note_id, greatest(1, coalesce(n, 0))::INT AS expected_lines, greatest(2, floor(coalesce(chars, 0) + 0.5))::INT AS expected_chars FROM notes LEFT JOIN b ON notes.note_id = b.note_id"""


def second_pass(spark, sf):
    e = evidence(spark, sf)
    a = E.assessed(e, lexicon(spark, sf), _context(e)).select("note_id", "seq", "text", "confidence", "assessment")
    cur = a.where("seq = 0").select("note_id", F.when(F.col("note_id") % 9 > 0, F.col("text")).alias("current_text"))
    best = a.where("seq = 7").select("note_id", F.when(F.col("note_id") % 14 > 0, F.col("text")).alias("text"), "confidence", "assessment", (F.col("note_id") % 5 * 1000).alias("budget_ms"))
    return E.second_pass(cur.join(best, "note_id")).select("note_id", "second_pass")


SECOND_PASS = _BASE + f""", {LEXICON}, {_ASSESS}, j AS (SELECT a.note_id, CASE WHEN a.note_id % 9 > 0 THEN a.text END AS ct, CASE WHEN b.note_id % 14 > 0 THEN b.text END AS bt, b.confidence, b.assessment, a.note_id % 5 * 1000 AS ms FROM s a JOIN s b ON a.note_id = b.note_id AND a.seq = 0 AND b.seq = 7)
SELECT note_id, (bt IS NULL OR confidence < 62 OR assessment < 0.62 OR (ct IS NOT NULL AND {_sim('ct', 'bt')} < 0.48)) AND ms >= 2500 AS second_pass FROM j"""


def _line_rows(spark, sf):
    d = table(spark, sf, "conversations").select(F.col("conv_id").alias("board_id"), F.col("conv_id").alias("note_id"), (F.col("turn") % 4).cast("int").alias("line_index"), F.col("turn").alias("seq"), "text")
    return d.withColumn("engine", F.lit("paddle")).withColumn("confidence", (F.col("seq") * 17 + F.col("note_id")) % 60 + 40)


def line_aggregate(spark, sf):
    out = E.join_lines(_line_rows(spark, sf))
    return out.select("note_id", F.md5("text").alias("hash"), F.col("confidence").cast("long").alias("confidence"))


_CL = "regexp_replace(" + _CLEAN.replace("@T", "text") + r", '\n+', ' ', 'g')"
LINE_AGGREGATE = f"""WITH l AS (SELECT conv_id AS note_id, turn % 4 AS i, turn AS seq, {_CL} AS c, (turn * 17 + conv_id) % 60 + 40 AS confidence FROM conversations),
g AS (SELECT note_id, string_agg(c, chr(10) ORDER BY i, seq, c) AS t, floor(sum(confidence * greatest(1, length(c)))::DOUBLE / sum(greatest(1, length(c))) + 0.5)::BIGINT AS confidence FROM l GROUP BY note_id)
SELECT note_id, md5({_CLEAN.replace('@T', 't')}) AS hash, confidence FROM g"""


def _current(spark, sf):
    return notes(spark, sf).select("board_id", "note_id", F.when(F.col("note_id") % 11 > 0, F.col("text")).alias("text"), "confidence", (F.col("note_id") % 10 / 10.0).alias("plausibility"), (F.col("note_id") % 13 / 13.0).alias("stability"))


_CURRENT = "cur AS (SELECT board_id, note_id, CASE WHEN note_id % 11 > 0 THEN text END AS text, confidence, note_id % 10 / 10.0::DOUBLE AS plausibility, note_id % 13 / 13.0::DOUBLE AS stability FROM notes)"


def fallback_topk(spark, sf):
    return _r(E.fallback_queue(_current(spark, sf)).withColumn("place", F.col("place").cast("long")), "urgency")


FALLBACK_TOPK = f"""WITH {NOTES}, {_CURRENT}, q AS (SELECT *, {_quality("coalesce(text, '')", 'confidence')} AS quality FROM cur),
u AS (SELECT *, CASE WHEN text IS NULL THEN 10000.0::DOUBLE ELSE (100 - confidence) * 2 + greatest(0, 60 - quality) * 1.5 + greatest(0, 0.65::DOUBLE - plausibility) * 100 END AS urgency FROM q WHERE text IS NULL OR confidence < 70 OR quality < 45 OR plausibility < 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY urgency DESC, note_id) AS place FROM u) SELECT board_id, note_id, round(urgency, 4) AS urgency, place, place <= 5 AS scheduled FROM r"""


def handwriting_queue(spark, sf):
    return _r(E.handwriting_queue(_current(spark, sf)).withColumn("place", F.col("place").cast("long")), "priority")


HANDWRITING_QUEUE = f"""WITH {NOTES}, {_CURRENT}, q AS (SELECT *, {_quality("coalesce(text, '')", 'confidence')} AS quality FROM cur),
u AS (SELECT *, CASE WHEN text IS NULL THEN 100.0::DOUBLE ELSE (1 - stability) * 35 + (1 - plausibility) * 30 + greatest(0, 70 - confidence) * 0.5 + greatest(0, 64 - quality) * 0.25 END AS priority FROM q WHERE text IS NULL OR stability < 0.7 OR plausibility < 0.55 OR quality < 64 OR confidence < 70)
SELECT board_id, note_id, round(priority, 4) AS priority, row_number() OVER (PARTITION BY board_id ORDER BY priority DESC, note_id) AS place FROM u"""


def _attempts(spark, sf):
    e = evidence(spark, sf)
    k = F.col("note_id") + F.col("seq")
    return e.select("board_id", "engine", (k % 37 > 0).alias("ok"), ((k % 41 == 0) & (F.col("engine") == "tesseract")).alias("skipped"), (k % 3 > 0).alias("found"), (k % 500).alias("elapsed_ms"))


def reader_status(spark, sf):
    return E.diagnostics(_attempts(spark, sf))


READER_STATUS = _BASE + """, a AS (SELECT board_id, engine, (note_id + seq) % 37 > 0 AS ok, (note_id + seq) % 41 = 0 AND engine = 'tesseract' AS skipped, (note_id + seq) % 3 > 0 AS found, (note_id + seq) % 500 AS ms FROM evidence),
g AS (SELECT board_id, engine, count(*) FILTER (NOT skipped) AS attempts, count(*) FILTER (found) AS candidates, count(*) FILTER (NOT ok AND NOT skipped) AS failures, count(*) FILTER (skipped) AS skipped, sum(ms)::BIGINT AS elapsed_ms FROM a GROUP BY ALL),
s AS (SELECT *, CASE WHEN attempts = 0 THEN 'skipped' WHEN failures > 0 AND candidates = 0 THEN 'failed' WHEN failures > 0 OR engine = 'tesseract' AND skipped > 0 THEN 'partial' ELSE 'ready' END AS status FROM g)
SELECT *, bool_or(engine IN ('paddle', 'dehtr') AND status IN ('failed', 'partial')) OVER (PARTITION BY board_id) AS degraded FROM s"""


def _finals(spark, sf):
    return notes(spark, sf).select("board_id", "note_id", F.col("text").alias("final_text"))


def vote_metrics(spark, sf):
    out = E.vote_metrics(evidence(spark, sf), _finals(spark, sf))
    return out.drop("board_id").withColumn("completeness", F.col("completeness").cast("long"))


VOTE_METRICS = _BASE + f""", j AS (SELECT e.note_id, e.seq, e.engine, e.confidence, {_one_byte(_words('e.text'))} AS a, {_words('n.text')} AS b FROM evidence e JOIN notes n ON e.note_id = n.note_id)
SELECT note_id, seq, engine, confidence, floor(least(length(a)::DOUBLE / greatest(1, length(b)) * 100, 100) + 0.5)::BIGINT AS completeness, least(greatest(floor((1 - levenshtein(a, b)::DOUBLE / greatest(1, length(a), length(b))) * 100 + 0.5), 0), 100)::BIGINT AS agreement FROM j"""


def token_agreement(spark, sf):
    return E.token_agreement(evidence(spark, sf), _finals(spark, sf)).drop("board_id").withColumn("pos", F.col("pos").cast("long"))


TOKEN_AGREEMENT = _BASE + f""", j AS (SELECT e.note_id, e.seq, regexp_split_to_array(trim(e.text), '\\s+') AS ts, string_split({_words('n.text')}, ' ') AS fs FROM evidence e JOIN notes n ON e.note_id = n.note_id),
u AS (SELECT note_id, seq, fs, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token FROM j) SELECT note_id, seq, pos, token, list_contains(fs, {_words('token')}) AS agrees FROM u"""


def adopt_rule(spark, sf):
    e = evidence(spark, sf)
    a = E.assessed(e, lexicon(spark, sf), _context(e)).select("note_id", "seq", "text", "assessment")
    cur = a.where("seq = 0").select("note_id", F.when(F.col("note_id") % 9 > 0, F.col("text")).alias("current_text"), F.col("assessment").alias("current_assessment"))
    alt = a.where("seq = 7").select("note_id", F.col("text").alias("fallback_text"), (F.col("assessment") + F.col("note_id") % 4 * 0.1 - 0.1).alias("fallback_assessment"))
    return E.adopt_fallback(cur.join(alt, "note_id")).select("note_id", "decision")


ADOPT_RULE = _BASE + f""", {LEXICON}, {_ASSESS}, j AS (SELECT a.note_id, CASE WHEN a.note_id % 9 > 0 THEN a.text END AS ct, a.assessment AS ca, b.text AS ft, b.assessment + a.note_id % 4 * 0.1::DOUBLE - 0.1::DOUBLE AS fa FROM s a JOIN s b ON a.note_id = b.note_id AND a.seq = 0 AND b.seq = 7)
SELECT note_id, CASE WHEN ct IS NULL THEN 'replace' WHEN {_sim('ct', 'ft')} >= 0.45 AND fa >= ca - 0.08::DOUBLE THEN 'fuse' WHEN fa >= ca + 0.22::DOUBLE THEN 'replace' ELSE 'keep' END AS decision FROM j"""


def _lexicons(spark, sf):
    w = table(spark, sf, "documents").select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    common = w.where("length(word) >= 3").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return common.where("n >= 20 and lang in ('de', 'en')").select("lang", "word")


_LEXICONS = "lex AS (SELECT lang, word FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents) WHERE length(word) >= 3 AND lang IN ('de', 'en') GROUP BY lang, word HAVING count(*) >= 20)"


def language_preference(spark, sf):
    texts = table(spark, sf, "conversations").select(F.col("conv_id").alias("board_id"), "text")
    return V.language_preference(texts, _lexicons(spark, sf))


LANGUAGE_PREFERENCE = f"""WITH {_LEXICONS}, w AS (SELECT conv_id AS board_id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''’-]*')) AS w FROM conversations),
k AS (SELECT board_id, lower(w) AS word FROM w WHERE length(w) >= 3), f AS (SELECT word, bool_or(lang = 'de') AS de, bool_or(lang = 'en') AS en FROM lex GROUP BY word),
c AS (SELECT k.board_id, count(*) FILTER (f.de AND NOT f.en) AS german_only, count(*) FILTER (f.en AND NOT f.de) AS english_only FROM k LEFT JOIN f ON k.word = f.word GROUP BY k.board_id)
SELECT board_id, german_only, english_only, CASE WHEN english_only >= german_only + 2 THEN 'en' WHEN german_only >= english_only + 2 THEN 'de' END AS preferred FROM c"""


def board_vocabulary(spark, sf):
    e = evidence(spark, sf)
    return V.vocabulary_evidence(e, lexicon(spark, sf)).select("board_id", "word", "n_notes", "n_sources", "n_engines")


BOARD_VOCABULARY = _BASE + f""", {LEXICON}, w AS (SELECT board_id, note_id, engine, variant, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}''’-]*'))) AS word FROM evidence)
SELECT board_id, word, count(DISTINCT note_id) AS n_notes, count(DISTINCT engine || ':' || variant) AS n_sources, count(DISTINCT engine) AS n_engines FROM w WHERE length(word) >= 4 AND word NOT IN (SELECT word FROM lexicon) AND word NOT IN (@T) GROUP BY board_id, word""".replace("@T", ", ".join(f"'{t}'" for t in V.PROTECTED_TERMS))


def history_tail(spark, sf):
    snaps = table(spark, sf, "events").select(F.col("user_id").alias("board_id"), F.col("event_id").alias("version"))
    return B.undo(snaps).select("board_id", "version", F.col("back").cast("long").alias("back"), "state")


HISTORY_TAIL = """WITH r AS (SELECT user_id AS board_id, event_id AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events)
SELECT board_id, version, back, CASE back WHEN 1 THEN 'redo' WHEN 2 THEN 'current' ELSE 'undo' END AS state FROM r WHERE back <= 40"""


def latest_generation(spark, sf):
    results = table(spark, sf, "events").select(F.col("user_id").alias("board_id"), F.floor(F.col("event_id") / 50).alias("generation"), "event_id")
    return B.latest_scan(results)


LATEST_GENERATION = "WITH g AS (SELECT user_id AS board_id, event_id // 50 AS generation, event_id FROM events) SELECT * FROM g QUALIFY generation = max(generation) OVER (PARTITION BY board_id)"

PAIRS = {
    "clean_text": (clean_text, CLEAN_TEXT),
    "usable_lines": (usable_lines, USABLE_LINES),
    "text_quality": (text_quality, TEXT_QUALITY),
    "simulated_readers": (simulated_readers, SIMULATED_READERS),
    "variant_similarity": (variant_similarity, VARIANT_SIMILARITY),
    "fuse_lines": (fuse_lines, FUSE_LINES),
    "weak_gate": (weak_gate, WEAK_GATE),
    "stability": (stability, STABILITY),
    "visual_context": (visual_context, VISUAL_CONTEXT),
    "second_pass": (second_pass, SECOND_PASS),
    "variant_matrix": (variant_matrix, VARIANT_MATRIX),
    "reader_top2": (reader_top2, READER_TOP2),
    "evidence_retention": (evidence_retention, EVIDENCE_RETENTION),
    "exact_vote": (exact_vote, EXACT_VOTE),
    "assess_text": (assess_text, ASSESS_TEXT),
    "collapse_readers": (collapse_readers, COLLAPSE_READERS),
    "line_aggregate": (line_aggregate, LINE_AGGREGATE),
    "fallback_topk": (fallback_topk, FALLBACK_TOPK),
    "handwriting_queue": (handwriting_queue, HANDWRITING_QUEUE),
    "reader_status": (reader_status, READER_STATUS),
    "vote_metrics": (vote_metrics, VOTE_METRICS),
    "token_agreement": (token_agreement, TOKEN_AGREEMENT),
    "adopt_rule": (adopt_rule, ADOPT_RULE),
    "language_preference": (language_preference, LANGUAGE_PREFERENCE),
    "board_vocabulary": (board_vocabulary, BOARD_VOCABULARY),
    "history_tail": (history_tail, HISTORY_TAIL),
    "latest_generation": (latest_generation, LATEST_GENERATION),
}
