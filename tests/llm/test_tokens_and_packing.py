"""Token ids, histograms and packing."""

import collections
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows_of
from tokenizers import Tokenizer

from pinwall.llm import common, packing, token_counts, tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(tokens.default_path())


def ids(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_chunks_encode_like_whole_texts(tokenizer, docs):
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x21, 0x7F)] * 2 + [chr(c) for c in range(0xA1, 0x250)] + ["́", "\x85", "\xa0", "İ", "Σ", "ς", "\x1c", "中", "😀", "'", "s", "<", "|"] + [" ", "\n"] * 40
    texts = ["".join(rng.choice(letters) for _ in range(80)) for _ in range(800)] + ["<|endoftext|> a", "x<|startoftext|>y", "", "  "]
    texts += [r["text"] or "" for r in rows_of(docs)]
    small = tokens.ChunkEncoder(tokens.default_path(), limit=50)
    for t in texts:
        assert np.frombuffer(small.ids(t), "<u4").tolist() == ids(tokenizer, t)


def test_many_texts_encode_like_each(tokenizer, docs, odd, monkeypatch):
    rng = random.Random(6)
    pieces = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "''", "'x", "\"", "!", "!!!!", "<", "|", "7", "42", "a", "the", "Th", "É", "é", "ß", "×", "÷", "ÿ", "À", "naïve", "-" * 40, "é" * 16, "é" * 17, "x" * 16, "X" * 17, "9" * 20]
    pieces += ["".join(rng.choice("etaoinsrhlé") for _ in range(rng.randint(1, 30))) for _ in range(200)]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", "", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(600)]
    texts += [None, "", " ", "\n\n", "'", "<|endoftext|> a", "x<", "|y", "a\tb", "\x00", "中 it's", "x" * 500, *(t * 20 for t in texts[:20])]
    texts += [r["text"] for df in (docs, odd) for r in rows_of(df)]
    want = [np.array(ids(tokenizer, t), "<u4").tobytes() for t in texts]
    assert tokens.ChunkEncoder(tokens.default_path()).many(texts) == want
    # texts of more than a step go in stretches; a single text or none is a block, too
    monkeypatch.setattr(tokens, "STEP", 64)
    small = tokens.ChunkEncoder(tokens.default_path(), limit=50)
    assert small.many(texts) == want
    assert small.many([]) == [] and [small.many([t])[0] for t in texts[:100]] == want[:100]


def test_merge_tables_hold_every_pair_and_no_other():
    made = tokens.Merges(tokens.default_path())
    rank = np.arange(len(made.made))
    keys = np.concatenate([keys[found < made.NONE] for _, keys, found in made.tables])
    assert len(keys) == len(set(keys.tolist()) | {0}) >= len(rank)
    assert sorted(made.ranks((keys >> 16).astype(np.uint16), (keys & 0xFFFF).astype(np.uint16)).tolist()) == rank.tolist()
    a, b = np.random.default_rng(1).integers(0, 49_000, (2, 100_000)).astype(np.uint16)
    assert ((made.ranks(a, b) < made.NONE) == np.isin(a.astype(np.uint32) << np.uint32(16) | b, keys)).all()


def test_unseen_words_are_not_encoded_one_by_one(spark, monkeypatch):
    """Most distinct words of a corpus are rare, so that a call of the vocabulary's model for each costs more than all else."""
    rng = random.Random(9)
    words = {"".join(rng.choice("etaoinsrhlu") for _ in range(rng.randint(6, 14))) for _ in range(3000)}
    made = tokens.ChunkEncoder(tokens.default_path())
    model, asked = made.tokenize, []
    made.tokenize = lambda w: asked.append(w) or model(w)
    monkeypatch.setattr(tokens, "encoder", lambda path: made)
    monkeypatch.setattr(packing.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
    taken = []
    monkeypatch.setattr(common, "map_batches", lambda df, run, schema: taken.append(run))
    packing.pieces(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    text = " ".join(sorted(words) + ["w" * 20])
    (got,) = taken[0]([pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})])
    assert asked == ["w" * 20]
    assert sum(got.column("length").to_pylist()) == len(made.ids(text)) // 4 + 1 and len(asked) > len(words) // 2


def test_histogram_answers_every_limit(docs, odd, empty, tokenizer):
    for df in (docs, odd):
        want = [len(ids(tokenizer, r["text"])) for r in rows_of(df)]
        hist = token_counts.length_histogram(token_counts.encoded_lengths(df)).cache()
        rows = {r["length"]: r for r in rows_of(hist)}
        assert {k: r["n_docs"] for k, r in rows.items()} == dict(collections.Counter(want))
        for k, r in rows.items():
            assert r["docs_at_least"] == sum(n >= k for n in want) and r["tokens_at_least"] == sum(n for n in want if n >= k)
            assert r["truncated_tokens"] == sum(min(n, k) for n in want) and r["quantile"] == pytest.approx(sum(n <= k for n in want) / len(want))
        for limit in (0, 7, 100, 10**6):
            r = token_counts.at_limit(hist, limit).first()
            assert (r.truncated_tokens, r.n_longer) == (sum(min(n, limit) for n in want), sum(n > limit for n in want))
        for share in (0.1, 0.5, 0.99):
            assert token_counts.quantile_length(hist, share).first()[0] == sorted(want)[int(np.ceil(share * len(want))) - 1]
    assert token_counts.length_histogram(token_counts.encoded_lengths(empty)).count() == 0


def test_histogram_is_written_to_few_files(spark, docs, monkeypatch):
    """A session of many shuffle partitions doesn't write a file for each: a few lengths would start hundreds of writers."""
    made, plain = [], common.written
    monkeypatch.setattr(common, "written", lambda df: made.append(plain(df)) or made[-1])
    wide = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wide}
    lengths = token_counts.encoded_lengths(docs)
    want = collections.Counter(r["n_tokens"] for r in rows_of(lengths))
    try:
        for k, v in wide.items():
            spark.conf.set(k, v)
        got = {r["length"]: r["n_docs"] for r in rows_of(token_counts.length_histogram(lengths))}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and len(want) > token_counts.FILES
    assert len(made) == 1 and 0 < len(made[0].inputFiles()) <= token_counts.FILES


def check_packing(rows, docs, tokenizer, capacity=2048):
    want = []
    for r in docs:
        all_ids = ids(tokenizer, r["text"]) + [0]
        for n, s in enumerate(range(0, len(all_ids), capacity)):
            part = all_ids[s : s + capacity]
            want.append((r["doc_id"], n, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows), key=str) == sorted(want, key=str)
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_documents_are_packed(docs, odd, empty, tokenizer):
    for df in (docs, odd):
        used, least = check_packing(rows_of(packing.pack_documents(df)), rows_of(df), tokenizer)
        assert used <= least + 1
    assert packing.pack_documents(empty).count() == 0


def test_blocks_and_levels_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 60)
    rng = random.Random(3)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(40, 60), 100]) for _ in range(400)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = rows_of(packing.pack(items, 100))
    assert sorted(r["item"] for r in got) == list(range(400))
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], lengths[r["item"]]))
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 100
    falling = packing.best_fit(sorted(range(400), key=lambda i: -lengths[i]), lengths, 100)
    assert len(bins) <= len(falling.bins) + 6


def test_crossover_keeps_every_item_once():
    rng = random.Random(8)
    lengths = [rng.randint(1, 60) for _ in range(150)]
    order = list(range(150))
    one = packing.best_fit(order, lengths, 100)
    rng.shuffle(order)
    two = packing.best_fit(order, lengths, 100)
    for _ in range(30):
        child = packing.crossover(one, two, lengths, 100, rng)
        for p in (child, packing.mutate(child, lengths, 100, rng)):
            assert sorted(i for b in p.bins for i in b) == list(range(150)) and all(sum(lengths[i] for i in b) == f <= 100 for b, f in zip(p.bins, p.fills))
    best, _ = packing.evolve(lengths, 100, seed=1, children=60)
    assert len(best.bins) <= len(packing.best_fit(sorted(range(150), key=lambda i: -lengths[i]), lengths, 100).bins)
    assert packing.evolve(lengths, 100, seed=1, children=60)[0].bins == best.bins


def test_evolution_beats_best_fit_decreasing(spark):
    """Lengths for which falling best fit is far from the best: crossovers happen, migrants are taken over, and the result needs fewer sequences."""
    rng = random.Random(21)
    lengths = [rng.randint(512, 922) for _ in range(3000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    used = packing.pack(items, 2048).select("sequence_id").distinct().count()
    falling = packing.best_fit(sorted(range(3000), key=lambda i: -lengths[i]), lengths, 2048)
    assert used < 0.99 * len(falling.bins)
    level = rows_of(packing._level(items, 2, 0, 2048))
    assert all(r["crossed"] > 0 for r in level)
    # an elite that comes from the other island lifts a population
    own, _ = packing.evolve(lengths[:1000], 2048, 1, children=2)
    other, _ = packing.evolve(lengths[:1000], 2048, 2, children=40)
    assert other.fitness() < own.fitness()
    after, crossed = packing.evolve(lengths[:1000], 2048, 3, [own, other], children=8)
    assert crossed == 8 and after.fitness() <= other.fitness()


def test_sequences_hold_the_ids(docs, tokenizer):
    from pinwall.llm import common

    small = docs.where("doc_id < 20")
    made = common.written(packing.pieces(small, with_ids=True, capacity=64))
    plan = packing.pack(made.select("item", "length"), 64)
    got = rows_of(packing.sequences(made, plan))
    total = sorted(t for r in rows_of(small) for t in ids(tokenizer, r["text"]) + [0])
    assert sorted(t for r in got for t in np.frombuffer(bytes(r["ids"]), "<u4").tolist()) == total
