"""Top-k search, source mixing and toxicity against plain versions."""

import collections
import math
import random
import zlib

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from pinwall.llm import mixing, topk, toxicity


def plain_top(rows, k):
    out = []
    for q, v in {(r["id"], tuple(r["v"])) for r in rows if r["id"] is not None and r["v"] is not None and r["id"] % 5 == 0}:
        scores = [(-sum(a * b for a, b in zip(v, r["v"])), r["id"]) for r in rows if r["id"] is not None and r["id"] != q and r["v"] is not None and len(r["v"]) == len(v)]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [40, 3])
def test_top_k_is_exact(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "LEAF", 16)
    monkeypatch.setattr(topk, "LEAVES", 2)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(spread)
    centers = rng.integers(-200, 200, (5, 6))
    rows = [(i, (centers[i % 5] + rng.integers(-spread, spread + 1, 6)).tolist()) for i in range(180)]
    rows += [(200 + i, [9, 9, 9, 9, 9, 9]) for i in range(60)] + [(300, [1, 2]), (305, [2, 1]), (310, []), (311, [0] * 6), (315, None), (None, [1] * 6), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(topk.top_k(df, F.col("id") % 5 == 0)))
    assert got == plain_top([{"id": i, "v": v} for i, v in rows], 5)
    assert topk.top_k(df.limit(0), F.col("id") % 5 == 0).count() == 0


def test_bounds_come_before_vectors(spark, monkeypatch):
    """On clustered vectors many pairs of query block and leaf are ruled out before any vector travels."""
    monkeypatch.setattr(topk, "LEAF", 32)
    monkeypatch.setattr(topk, "QUERIES", 16)
    for n in (2000, 8000):
        rng = np.random.default_rng(7)
        centers = rng.normal(size=(n // 100, 16))
        centers = 2000 * centers / np.linalg.norm(centers, axis=1)[:, None]
        x = (centers[np.arange(n) % len(centers)] + rng.normal(scale=15, size=(n, 16))).astype(int)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<long>")
        index, pivots, top = topk.build_index(df, "id", "v", F.col("id") % 50 < 2)
        blocks = topk._query_blocks(topk._first_scores(index, pivots, 5)).cache()
        meetings = topk._meetings(index, blocks, top).count()
        pairs = blocks.count() * index.count()
        print(f"{n} rows: {meetings} of {pairs} pairs meet")
        assert meetings < 0.7 * pairs


def test_integers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.001]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, [None, 1.0]), (5, None), (6, [])]
    got = {r.i: r.v for r in spark.createDataFrame(rows, "i int, e array<float>").select("i", topk.integers("e").alias("v")).collect()}
    assert got == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


def test_huge_components_stay_exact():
    a = np.array([[1 << 40, 3]])
    assert topk._inner(a, np.array([[1 << 20, 5]]))[0, 0] == (1 << 60) + 15


def plain_targets(sizes):
    """Water filling by repeated resharing."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        level = rest / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if w[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else w[s] * level for s in order}
        capped |= over


@pytest.mark.parametrize("ranges", [4096, 3])
def test_mix_meets_its_targets(odd, docs, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    for df in (docs, odd):
        rows = rows_of(mixing.mix(mixing.scored(df, F.struct("doc_id", "text"))))
        assert len(rows) == df.count()
        sizes = collections.Counter()
        for r in rows:
            assert r["size"] == len((r["kept"]["text"] or "").encode().split()) and 0 <= r["taken"] <= 2 * r["size"]
            sizes[r["source"]] += r["size"]
        want = plain_targets(dict(sizes))
        taken, rows_in = collections.Counter(), collections.Counter(r["source"] for r in rows)
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
            taken[r["source"]] += r["taken"]
        for s, t in want.items():
            # equal rows share a part evenly, rounded down
            assert t - 1 - (rows_in[s] if df is odd else 0) <= taken[s] <= t
        again = rows_of(mixing.mix(mixing.scored(df.repartition(5), F.struct("doc_id", "text"))))
        key = lambda r: str((r["kept"], r["taken"]))
        assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_prefers_quality_and_takes_empty_tables(spark, empty):
    assert mixing.mix(mixing.scored(empty, F.col("doc_id"))).count() == 0
    rows = [(i, ("good words " if i % 2 else "### $$$ ") * 5, "a", "s") for i in range(400)] + [(1000, "z " * 9000, "a", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = [r for r in rows_of(mixing.mix(mixing.scored(df, F.col("doc_id")), weights=(1, 9), ratio=1.0)) if r["source"] == "s"]
    good, bad = (sum(r["taken"] for r in got if r["kept"] % 2 == x) for x in (1, 0))
    assert good > 1.5 * bad > 0


@pytest.mark.parametrize("rows_of_a_range, bits", [(1, 3), (7, 12)])
def test_mix_by_any_ranges(spark, monkeypatch, rows_of_a_range, bits):
    """However finely a source's keys are looked into, the same documents are taken."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w", "#$%", "9"][rng.randint(0, 2)] for _ in range(rng.randint(0, 30))), ["a", "b", "c", None][i % 4]) for i in range(300)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string")
    key = lambda r: str((r["kept"], r["taken"]))
    want = sorted(map(key, rows_of(mixing.mix(mixing.scored(df, F.col("doc_id"))))))
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows_of_a_range)
    monkeypatch.setattr(mixing, "DIGIT_BITS", bits)
    assert sorted(map(key, rows_of(mixing.mix(mixing.scored(df, F.col("doc_id")))))) == want


RUDE = ("idiot", "moron", "scum")


def labelled(spark, n=900):
    rng = random.Random(13)
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(f"w{chr(97 + rng.randint(0, 25))}{chr(97 + rng.randint(0, 25))}" for _ in range(8)) for _ in range(rng.randint(1, 12))]
        if i % 6 == 0:
            at = rng.randrange(len(sentences))
            sentences[at] = f"you {rng.choice(RUDE)} " + sentences[at]
        rows.append((i, ". ".join(sentences) + ".\n"))
        labels.append((i, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels + [(5, None), (None, 1)], "doc_id long, toxic int")


def test_toxicity_learns_from_document_labels(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in rows_of(docs.select("doc_id", "text", toxicity.scorer(model)("text").alias("score"), toxicity.locator(model)("text").alias("found")))}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i]["score"] >= toxicity.THRESHOLD) == (i % 6 == 0) for i in held)
    assert right >= 0.97 * len(held) > 100
    hits = [got[i] for i in held if i % 6 == 0 and got[i]["score"] >= toxicity.THRESHOLD]
    for r in hits:
        spans = [r["text"][s["start"] : s["end"]] for s in r["found"]]
        assert sum(any(w in t for w in RUDE) for t in spans) >= 1
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert (again.weights == model.weights).all() and again.bias == model.bias


def test_scores_are_noisy_or(spark, odd, empty):
    model = toxicity.Model(-4.0, np.zeros(toxicity.FEATURES))
    for f in toxicity.features("scum"):
        model.weights[f] = 1.5
    p = lambda z: 1 / (1 + math.exp(-z))
    text = "Hello there. You scum! bye"
    extra = 1.5 * len(toxicity.features("scum"))
    assert model.score(text) == pytest.approx(1 - (1 - p(-4)) ** 2 * (1 - p(-4 + extra)))
    assert model.score(None) == model.score("") == model.score(" .!\n") == pytest.approx(p(-4))
    assert [text[s:e] for s, e in toxicity.sentences(text)] == ["Hello there.", "You scum!", "bye"]
    scored = odd.select(toxicity.scorer(model)("text").alias("p"))
    assert scored.count() == odd.count() and scored.where("p is null or p < 0 or p > 1").count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    flat = toxicity.train(odd, none)
    assert flat.score("anything") < 0.01 and toxicity.train(empty, none).score("") < 0.01
    one_class = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.train(odd, one_class).score("x") < toxicity.THRESHOLD


def test_held_out_rows(spark):
    got = {r.doc_id: r.h for r in spark.range(300).select(F.col("id").alias("doc_id"), toxicity.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(300)}


def test_length_alone_is_not_toxic(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels)
    clean = [t for i, t in sorted(map(tuple, docs.collect())) if i % 6]
    assert max(map(model.score, clean)) < toxicity.THRESHOLD
    for size in (1_000, 100_000, 800_000):
        text = "\n".join(clean * (1 + size // sum(map(len, clean))))
        assert len(text) > size
        assert model.score(text) == pytest.approx(max(map(model.score, clean)))
        for at in (0, len(text) // 2, len(text)):
            at = text.find("\n", at) if 0 < at < len(text) else at
            assert model.score(f"{text[:at]}\nyou utter {RUDE[0]}.\n{text[at:]}") >= toxicity.THRESHOLD
