"""Readings of notes: simulation, retention, votes, gates and matrices over tables of evidence.

Evidence has board_id, note_id, seq (arrival order within the note), engine, variant, scope
("note" or "line"), line_index, text and confidence. All groupings are by note, whose
evidence is bounded, so windows and self-joins stay small at any number of boards. Exploded
readings are many times what Spark expects them to be, so joins with a row for each note or
reading are told to merge; otherwise a side would be broadcast by way of the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pinwall.functions import text as T
from pinwall.functions.constants import PROTECTED_TERMS, READERS
from pinwall.functions.similarity import folded

NOTE = ["board_id", "note_id"]
VARIANTS = ("rgb", "contrast", "gray", "sauvola", "ink", "line")


def is_selected(variant: Column) -> Column:
    """Chosen or fused from other readings, not measured."""
    return F.coalesce((variant == "selected") | variant.contains("fusion"), F.lit(False))


def simulate(notes: DataFrame) -> DataFrame:
    """One reading for each of the three readers: each misreads by the first of its two rules that applies, as a deterministic stand-in."""
    text = F.when(F.length(F.col("text")) > 0, F.col("text"))
    rules = {
        "paddle": (5, [("(?i)o", "0"), ("(?i)i", "l")]),
        "dehtr": (-1, [("(?i)rn", "m"), (r"\s+", " ")]),
        "tesseract": (-8, [("(?i)l", "1"), ("(?i)s", "5")]),
    }
    rows = []
    for i, (engine, (shift, pairs)) in enumerate(rules.items()):
        read = text
        for pattern, put in reversed(pairs):
            # only the first match changes unless the rule squeezes blanks
            once = F.regexp_replace(text, pattern, put) if "+" in pattern else F.regexp_replace(text, f"^(.*?)(?s:{pattern})", f"$1{put}")
            read = F.when(text.rlike(pattern), once).otherwise(read)
        rows.append(F.struct(F.lit(i).alias("seq"), F.lit(engine).alias("engine"), read.alias("text"), T.clamp(F.col("confidence") + shift, 35, 94).alias("confidence")))
    out = notes.select(*NOTE, F.explode(F.array(*rows)).alias("r"))
    return out.select(*NOTE, F.col("r.seq").cast("long").alias("seq"), "r.engine", F.lit("simulation").alias("variant"), F.lit("note").alias("scope"), F.lit(None).cast("int").alias("line_index"), "r.text", "r.confidence")


def retain(evidence: DataFrame) -> DataFrame:
    """Per note and reader the 4 best distinct readings, per line and reader the 2 best.

    Texts are equal if their NFKC forms have the same letters and digits. Exact for streams of
    measured readings. Where selected, fused or aggregated readings
    arrive among them, what is dropped early matters: use fold.fold_evidence.
    """
    group = [*NOTE, "engine", "scope", "line_index"]
    rows = evidence.withColumn("norm", T.normalized_line(folded(F.col("text"))))
    distinct = rows.withColumn("r", F.row_number().over(Window.partitionBy(*group, "norm").orderBy(F.col("confidence").desc(), "seq"))).where("r = 1")
    # of equals, the text that reached its confidence first stands first
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("confidence").desc(), "seq"))
    limit = F.when(F.col("scope") == "note", 4).otherwise(2)
    return distinct.drop("norm", "r").withColumn("place", place).where(F.col("place") <= limit)


def reader_top(evidence: DataFrame, k: int = 2) -> DataFrame:
    """The k readings shown for each reader: whole notes first, then by confidence."""
    order = Window.partitionBy(*NOTE, "engine").orderBy((F.col("scope") == "note").desc(), F.col("confidence").desc(), "seq")
    return evidence.where(F.trim("text") != "").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def variant_class(variant: Column) -> Column:
    v = F.lower(variant)
    return (
        F.when(v.endswith("-rgb"), "rgb")
        .when(v.contains("line"), "line")
        .when(v.contains("contrast"), "contrast")
        .when(v.contains("gray"), "gray")
        .when(v.contains("sauvola"), "sauvola")
        .when(v.endswith("-ink"), "ink")
    )


def variant_matrix(evidence: DataFrame) -> DataFrame:
    """Best confidence of each reader (rows) on each image variant (columns)."""
    rows = evidence.withColumn("class", variant_class(F.col("variant"))).where(F.col("class").isNotNull())
    return rows.groupBy(*NOTE, "engine").pivot("class", list(VARIANTS)).agg(F.max("confidence"))


def pair_similarity(evidence: DataFrame, *keep: str) -> DataFrame:
    """note, left_seq, right_seq, left_ and right_ of `keep`, similarity: each two readings of a note once, the earlier one left. Texts are normalized once a reading."""
    rows = evidence.select(*NOTE, "seq", *keep, T.normalized_line(F.col("text")).alias("norm"))
    left = rows.select(*NOTE, *(F.col(c).alias(f"left_{c}") for c in ("seq", *keep, "norm")))
    right = rows.select(*NOTE, *(F.col(c).alias(f"right_{c}") for c in ("seq", *keep, "norm")))
    pairs = left.join(right.hint("merge"), NOTE).where("left_seq < right_seq")
    return pairs.withColumn("similarity", T.key_similarity(F.col("left_norm"), F.col("right_norm"))).drop("left_norm", "right_norm")


def pair_agreement(evidence: DataFrame) -> DataFrame:
    """note and the greatest similarity of any two of its readings (0 for a single one)."""
    best = pair_similarity(evidence).groupBy(*NOTE).agg(F.max("similarity").alias("agreement"))
    return evidence.select(*NOTE).distinct().join(best.hint("merge"), NOTE, "left").select(*NOTE, F.coalesce("agreement", F.lit(0.0)).alias("agreement"))


def best_reading(evidence: DataFrame) -> DataFrame:
    """The reading of the best text quality; the earlier one of equals."""
    quality = T.text_quality(F.col("text"), F.col("confidence"))
    order = Window.partitionBy(*NOTE).orderBy(F.col("quality").desc(), "seq")
    return evidence.withColumn("quality", quality).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def weak_notes(evidence: DataFrame, fused: DataFrame) -> DataFrame:
    """Notes that need another reading: little agreement, poor text, or unsure and not well confirmed.

    The fused reading (fused: note, text, confidence) is judged, or the best single one of a
    note that has none.
    """
    best = best_reading(evidence).select(*NOTE, F.col("text").alias("b_text"), F.col("confidence").cast("long").alias("b_confidence"))
    mine = fused.select(*NOTE, F.col("text").alias("f_text"), F.col("confidence").cast("long").alias("f_confidence"))
    current = best.join(mine.hint("merge"), NOTE, "left").select(*NOTE, F.coalesce("f_text", "b_text").alias("text"), F.when(F.col("f_text").isNotNull(), F.col("f_confidence")).otherwise(F.col("b_confidence")).alias("confidence"))
    joined = current.withColumn("quality", T.text_quality(F.col("text"), F.col("confidence"))).join(pair_agreement(evidence).hint("merge"), NOTE)
    weak = (F.col("agreement") < 0.62) | (F.col("quality") < 62) | ((F.col("confidence") < 74) & (F.col("agreement") < 0.86))
    return joined.select(*NOTE, "agreement", "quality", "confidence", weak.alias("weak"))


def stability(evidence: DataFrame, selected: DataFrame) -> DataFrame:
    """note, stability: the greatest similarity of its selected text (selected: note, text) to its readings, 0 without any. Leave the selected reading itself out of evidence if it is one of them."""
    mine = selected.select(*NOTE, T.normalized_line(F.col("text")).alias("a"))
    peers = evidence.select(*NOTE, T.normalized_line(F.col("text")).alias("b"))
    best = mine.join(peers.hint("merge"), NOTE, "left").groupBy(*NOTE).agg(F.max(T.key_similarity(F.col("a"), F.col("b"))).alias("s"))
    return best.select(*NOTE, F.coalesce("s", F.lit(0.0)).alias("stability"))


def visual_context(notes: DataFrame, bands: DataFrame) -> DataFrame:
    """note, expected_lines, expected_chars: what its text bands (note, width, height) let expect; one line and two characters without any."""
    wide = T.clamp(F.col("width") / F.greatest(F.lit(1.0), F.col("height")) * 2.2, 2.0, 18.0)
    seen = bands.groupBy(*NOTE).agg(F.count(F.lit(1)).alias("n"), F.sum(wide).alias("chars"))
    out = notes.select(*NOTE).distinct().join(seen, NOTE, "left")
    lines, chars = F.greatest(F.lit(1), F.coalesce("n", F.lit(0))), F.greatest(F.lit(2), T.js_round(F.coalesce("chars", F.lit(0.0))))
    return out.select(*NOTE, lines.cast("int").alias("expected_lines"), chars.cast("int").alias("expected_chars"))


def second_pass(best: DataFrame, least_ms: int = 2500) -> DataFrame:
    """Whether the slow reader reads a note once more; best has its text, confidence, assessment, the current text and the budget left (budget_ms)."""
    apart = F.col("current_text").isNotNull() & (T.similarity(F.col("current_text"), F.col("text")) < 0.48)
    unsure = F.col("text").isNull() | (F.col("confidence") < 62) | (F.col("assessment") < 0.62) | F.coalesce(apart, F.lit(False))
    return best.withColumn("second_pass", unsure & (F.col("budget_ms") >= least_ms))


def exact_vote(evidence: DataFrame) -> DataFrame:
    """Distinct texts of a note ranked by how many readers, then sources, then confidence stand behind them; confirmed: two readers or more and no equal rival."""
    rows = evidence.where((F.col("scope") == "note") & (F.trim("text") != "")).withColumn("norm", T.normalized_text(folded(F.col("text"))))
    measured = ~is_selected(F.col("variant"))
    any_measured = F.max(measured.cast("int")).over(Window.partitionBy(*NOTE, "norm")) == 1
    counted = rows.withColumn("measured", measured).withColumn("any_measured", any_measured)
    source = F.when(F.col("measured") | ~F.col("any_measured"), F.concat_ws(":", "engine", F.coalesce("variant", F.lit("default"))))
    engine = F.when(source.isNotNull(), F.col("engine"))
    votes = counted.groupBy(*NOTE, "norm").agg(
        F.count_distinct(engine).alias("engines"),
        F.count_distinct(source).alias("sources"),
        F.avg(F.when(source.isNotNull(), T.clamp(F.col("confidence"), 0, 100))).alias("confidence"),
        F.min("seq").alias("seq"),
    )
    rank = Window.partitionBy(*NOTE).orderBy(F.col("engines").desc(), F.col("sources").desc(), F.col("confidence").desc(), "seq")
    rival = F.struct("engines", "sources")
    out = votes.withColumn("place", F.row_number().over(rank)).withColumn("next", F.lead(rival).over(rank))
    clear = F.col("next").isNull() | (F.struct("engines", "sources") > F.col("next"))
    return out.select(*NOTE, "norm", "engines", "sources", "confidence", "place", ((F.col("place") == 1) & (F.col("engines") >= 2) & clear).alias("confirmed"))


def assessed(evidence: DataFrame, lexicon: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """evidence with n_words, n_known (words that the lexicon or the protected terms have) and assessment; context may give expected_lines and expected_chars of notes.

    lexicon has one column, word, in lower case. Words are exploded and joined to it, so its
    size doesn't matter; counts come back by reading.
    """
    key = [*NOTE, "seq"]
    spread = evidence.select(*key, F.explode(T.words(F.col("text"))).alias("w")).select(*key, F.lower("w").alias("word"))
    known = spread.join(lexicon.select("word").distinct().withColumn("hit", F.lit(1)), "word", "left").groupBy(*key).agg(F.count(F.lit(1)).alias("n_words"), F.count(F.when(F.col("hit").isNotNull() | F.col("word").isin(*PROTECTED_TERMS), 1)).alias("n_known"))
    out = evidence.join(known.hint("merge"), key, "left").fillna(0, ["n_words", "n_known"])
    if context is not None:
        out = out.join(context.hint("merge"), NOTE, "left")
    else:
        out = out.withColumn("expected_lines", F.lit(None).cast("int")).withColumn("expected_chars", F.lit(None).cast("int"))
    return out.withColumn("assessment", T.assess(F.col("text"), F.col("confidence").cast("double"), F.col("n_known"), F.col("expected_lines"), F.col("expected_chars")))


def collapse_readers(evidence: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The best variant of each reader: assessment, agreement with its own and, more, with other readers' variants, and completeness."""
    whole = evidence.where((F.col("scope") == "note") & (F.size(T.usable_lines(F.col("text"))) > 0))
    context = whole.groupBy(*NOTE).agg(F.max(F.size(T.usable_lines(F.col("text")))).alias("expected_lines"), F.max(F.greatest(F.lit(1), F.length(T.normalized_line(F.col("text"))))).alias("expected_chars"))
    rows = assessed(whole, lexicon, context)
    pairs = pair_similarity(whole, "engine")
    same = F.col("left_engine") == F.col("right_engine")
    sides = pairs.select(*NOTE, F.explode(F.array("left_seq", "right_seq")).alias("seq"), F.when(same, F.col("similarity")).alias("s"), F.when(~same, F.col("similarity")).alias("c"))
    near = sides.groupBy(*NOTE, "seq").agg(F.max("s").alias("same"), F.max("c").alias("cross"))
    score = (
        F.col("assessment") * 2.4
        + F.coalesce("same", F.lit(0.0)) * 0.55
        + F.coalesce("cross", F.lit(0.0)) * 2.0
        + F.least(F.size(T.usable_lines(F.col("text"))), F.lit(6)) * 0.06
        + T.clamp(F.length(T.normalized_line(F.col("text"))) / F.greatest(F.lit(1), F.col("expected_chars")), 0.0, 1.0) * 0.16
    )
    rows = rows.join(near.hint("merge"), [*NOTE, "seq"], "left").withColumn("score", score)
    order = Window.partitionBy(*NOTE, "engine").orderBy(F.col("score").desc(), "seq")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select(*NOTE, "engine", "seq", "variant", "text", "confidence", "score")


def join_lines(lines: DataFrame) -> DataFrame:
    """Line readings of a note and reader as one text in line order, with the confidence weighted by length."""
    clean = F.regexp_replace(T.clean_text(F.col("text")), r"\n+", " ")
    rows = lines.withColumn("clean", clean).withColumn("weight", F.greatest(F.lit(1), F.length("clean")))
    out = rows.groupBy(*NOTE, "engine").agg(
        F.sort_array(F.collect_list(F.struct("line_index", "seq", "clean"))).alias("parts"),
        T.js_round(F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight")).alias("confidence"),
    )
    return out.select(*NOTE, "engine", T.clean_text(F.array_join(F.transform("parts", lambda p: p["clean"]), "\n")).alias("text"), "confidence")


def fallback_queue(current: DataFrame, k: int = 5) -> DataFrame:
    """Per board the k notes that most need the slow reader, among those that need it; current has text, confidence, plausibility.

    Skipped notes (beyond k) are returned too, so that nothing is lost silently.
    """
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    quality = T.text_quality(F.coalesce("text", F.lit("")), F.col("confidence"))
    urgent = F.when(blank, 10000.0).otherwise(
        (100 - F.col("confidence")) * 2.0 + F.greatest(F.lit(0.0), 60 - quality) * 1.5 + F.greatest(F.lit(0.0), 0.65 - F.col("plausibility")) * 100.0
    )
    needs = blank | (F.col("confidence") < 70) | (quality < 45) | (F.col("plausibility") < 0.5)
    order = Window.partitionBy("board_id").orderBy(F.col("urgency").desc(), "note_id")
    rows = current.withColumn("urgency", urgent).where(needs).withColumn("place", F.row_number().over(order))
    return rows.select(*NOTE, "urgency", "place", (F.col("place") <= k).alias("scheduled"))


def handwriting_queue(current: DataFrame) -> DataFrame:
    """Notes for the handwriting reader by priority; current has text, confidence, stability, plausibility."""
    quality = T.text_quality(F.coalesce("text", F.lit("")), F.col("confidence"))
    missing = F.col("text").isNull()
    gate = missing | (F.col("stability") < 0.7) | (F.col("plausibility") < 0.55) | (quality < 64) | (F.col("confidence") < 70)
    priority = F.when(missing, 100.0).otherwise(
        (1 - F.col("stability")) * 35.0 + (1 - F.col("plausibility")) * 30.0 + F.greatest(F.lit(0), 70 - F.col("confidence")) * 0.5 + F.greatest(F.lit(0.0), 64 - quality) * 0.25
    )
    order = Window.partitionBy("board_id").orderBy(F.col("priority").desc(), "note_id")
    return current.where(gate).withColumn("priority", priority).withColumn("place", F.row_number().over(order)).select(*NOTE, "priority", "place")


def adopt_fallback(pairs: DataFrame) -> DataFrame:
    """What becomes of a fallback reading: "fuse", "replace" or "keep"; pairs has current and fallback text and assessments."""
    s = T.similarity(F.col("current_text"), F.col("fallback_text"))
    rule = (
        F.when(F.col("current_text").isNull(), "replace")
        .when((s >= 0.45) & (F.col("fallback_assessment") >= F.col("current_assessment") - 0.08), "fuse")
        .when(F.col("fallback_assessment") >= F.col("current_assessment") + 0.22, "replace")
        .otherwise("keep")
    )
    return pairs.withColumn("decision", rule)


def diagnostics(attempts: DataFrame) -> DataFrame:
    """Status of each reader on each board; attempts has one row for each try: engine, ok, skipped, found, elapsed_ms."""
    per = attempts.groupBy("board_id", "engine").agg(
        F.count(F.when(~F.col("skipped"), 1)).alias("attempts"),
        F.count(F.when(F.col("found"), 1)).alias("candidates"),
        F.count(F.when(~F.col("ok") & ~F.col("skipped"), 1)).alias("failures"),
        F.count(F.when(F.col("skipped"), 1)).alias("skipped"),
        F.sum("elapsed_ms").alias("elapsed_ms"),
    )
    status = (
        F.when((F.col("attempts") == 0), "skipped")
        .when((F.col("failures") > 0) & (F.col("candidates") == 0), "failed")
        .when((F.col("failures") > 0) | ((F.col("engine") == "tesseract") & (F.col("skipped") > 0)), "partial")
        .otherwise("ready")
    )
    per = per.withColumn("status", status)
    bad = F.col("engine").isin(*READERS[:2]) & F.col("status").isin("failed", "partial")
    return per.withColumn("degraded", F.max(bad.cast("int")).over(Window.partitionBy("board_id")) == 1)


def vote_metrics(evidence: DataFrame, finals: DataFrame, limit: int = 24) -> DataFrame:
    """Agreement with and completeness against the final text, of the first `limit` readings of each note; finals has final_text."""
    order = Window.partitionBy(*NOTE).orderBy("seq")
    rows = evidence.withColumn("index", F.row_number().over(order) - 1).where(F.col("index") < limit).join(finals, NOTE)
    return rows.select(*NOTE, "seq", "engine", "confidence", T.completeness(F.col("text"), F.col("final_text")).alias("completeness"), T.text_agreement(F.col("text"), F.col("final_text")).cast("long").alias("agreement"))


def token_agreement(evidence: DataFrame, finals: DataFrame) -> DataFrame:
    """Each token of each reading and whether the final text has it."""
    rows = evidence.join(finals.hint("merge"), NOTE)
    words = F.split(T.normalized_text(F.col("final_text")), " ")
    out = rows.select(*NOTE, "seq", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "token"), words.alias("finals"))
    return out.select(*NOTE, "seq", "pos", "token", F.array_contains("finals", T.normalized_text(F.col("token"))).alias("agrees"))
