"""Line, substring and near-duplicate removal against plain versions, and their odd cases."""

import collections
import hashlib
import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import Window
from pyspark.sql import functions as F

from pinwall.llm import common, graph, line_dedup, neardup, substring_dedup


def plain_lines(rows):
    seen, gone = {}, collections.defaultdict(set)
    order = sorted((r["doc_id"], p) for r in rows if r["text"] is not None for p in range(len(r["text"].split("\n")) - 2))
    lines = {r["doc_id"]: (r["text"] or "").split("\n") for r in rows}
    for d, p in order:
        w = tuple(lines[d][p : p + 3])
        if w in seen:
            gone[d] |= {p, p + 1, p + 2}
        seen.setdefault(w, (d, p))
    return {r["doc_id"]: (0 if r["text"] is None else len(lines[r["doc_id"]]), len(gone[r["doc_id"]]), None if r["text"] is None else "\n".join(x for i, x in enumerate(lines[r["doc_id"]]) if i not in gone[r["doc_id"]])) for r in rows}


def test_lines_against_plain(docs):
    got = {r["row"]["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_text"]) for r in rows_of(line_dedup.line_dedup(docs))}
    assert got == plain_lines(rows_of(docs))
    assert sum(v[1] for v in got.values()) > 30


def plain_substrings(rows, w):
    words = {i: (r["text"] or "").encode().split() for i, r in enumerate(rows)}
    count = collections.Counter(b" ".join(x[p : p + w]) for x in words.values() for p in range(len(x) - w + 1))
    out = []
    for i, r in enumerate(rows):
        gone = [False] * len(words[i])
        for p in range(len(words[i]) - w + 1):
            if count[b" ".join(words[i][p : p + w])] > 1:
                gone[p : p + w] = [True] * w
        kept = b" ".join(x for x, g in zip(words[i], gone) if not g)
        out.append((r["doc_id"], len(words[i]), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot, step, bits", [(256, 1 << 16, 1 << 26), (1, 1 << 16, 1 << 26), (2, 300, 64)])
def test_substrings_against_plain(docs, monkeypatch, hot, step, bits):
    """Few and many occurrences a run; long texts in stretches; a filter that is full at once."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(common, "STEP", step)
    monkeypatch.setattr(substring_dedup, "FILTER_BITS", bits)
    got = rows_of(substring_dedup.substring_dedup(docs))
    assert sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == plain_substrings(rows_of(docs), 35)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_substrings_of_odd_rows(odd, empty):
    got = rows_of(substring_dedup.substring_dedup(odd, with_text=False))
    assert sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == plain_substrings(rows_of(odd), 35)
    assert substring_dedup.substring_dedup(empty).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(empty, window=5)


def test_suffix_automaton_counts():
    rng = random.Random(2)
    for _ in range(60):
        seqs = [[rng.randint(0, 2) for _ in range(rng.randint(1, 25))] for _ in range(4)]
        weights = [rng.randint(1, 2) for _ in seqs]
        sam = substring_dedup.SuffixAutomaton()
        for s, k in zip(seqs, weights):
            sam.add(s, k)
        sam.seal()
        count = collections.Counter()
        for s, k in zip(seqs, weights):
            for p in range(len(s) - 3):
                count[tuple(s[p : p + 4])] += k
        for s in seqs:
            assert sam.repeated(s, 4) == [p for p in range(len(s) - 3) if count[tuple(s[p : p + 4])] > 1]


def test_segments_partition_windows():
    rng = np.random.default_rng(5)
    for sizes in ([35], [36, 35, 400], [100, 0, 300, 3, 41], [7]):
        words = common.Words([b" ".join(b"%x" % x for x in rng.integers(0, 3 if 100 in sizes else 1 << 40, k)) for k in sizes], sizes)
        assert len(words) == sum(sizes) and np.diff(words.begin).tolist() == sizes
        starts = words.windows(35)
        assert starts.tolist() == [b + s for b, k in zip(words.begin.tolist(), sizes) for s in range(k - 34)]
        grams = words.hashes().fixed(8) if len(words) >= 8 else np.zeros(0, np.uint64)
        h, first, last = substring_dedup.segments(grams, starts, 35)
        assert [s for a, b in zip(first.tolist(), last.tolist()) for s in range(a, b + 1)] == starts.tolist() and (last - first < 28).all()
        assert all(x >> np.uint64(20) == grams[a : a + 28].min() >> np.uint64(20) for x, a in zip(h, first))


def test_word_blocks_cover_long_texts():
    rng = random.Random(6)
    texts = [b" \t".join(b"w%d" % rng.randint(0, 99) for _ in range(n)) for n in (0, 3, 50, 400, 1000)] + [b"x" * 5000 + b" a b", b"  "]
    for step, overlap in ((64, 0), (100, 4), (100, 34), (1 << 19, 34)):
        seen = {i: {} for i in range(len(texts))}
        for block in common.word_blocks(enumerate(texts), overlap, step):
            one, two = block.hashes(0), block.hashes(1)
            for (i, at), a, b in zip(block.tags, block.begin.tolist(), block.begin[1:].tolist()):
                assert block.texts(np.array([a]), np.array([b - 1]))[0].split() == texts[i].split()[at : at + b - a] if b > a else True
                for w in range(a, b - overlap):
                    x, y = np.array([w]), np.array([w + overlap + 1])
                    assert at + w - a not in seen[i]
                    seen[i][at + w - a] = (int(one.spans(x, y)[0]), int(two.spans(x, y)[0]))
        for i, t in enumerate(texts):
            words = t.split()
            assert sorted(seen[i]) == list(range(max(0, len(words) - overlap)))
        runs = {}
        for i, t in enumerate(texts):
            words = t.split()
            for w, h in seen[i].items():
                assert runs.setdefault(h, words[w : w + overlap + 1]) == words[w : w + overlap + 1]
        assert len(runs) == len({tuple(x) for x in runs.values()})


def test_word_runs():
    rng = random.Random(4)
    for n in (0, 1, 7, 8, 9, 50):
        words = [b"w%d" % rng.randint(0, 9) for _ in range(n)]
        data = b" \n".join(words) + b" \t"
        for step, overlap in ((4, 0), (5, 3), (100, 34)):
            got = list(common.word_runs(data, step, overlap))
            assert all(r == words[at : at + len(r)] for at, r in got) and sum(len(r) for _, r in got) - overlap * (len(got) - 1) == n
            assert max(len(r) for _, r in got) <= step + overlap


def test_one_passage_in_many_documents(spark):
    """A window that every document holds is one row where it is decided."""
    passage = " ".join(f"p{i}" for i in range(70))
    docs = spark.range(3000).selectExpr("id as doc_id", f"concat_ws(' ', transform(sequence(1, 40), i -> concat('a', id, '_', i)), '{passage}', transform(sequence(1, 40), i -> concat('b', id, '_', i))) as text")
    got = rows_of(substring_dedup.substring_dedup(docs).groupBy("n_words", "n_removed").count())
    assert [(r["n_words"], r["n_removed"], r["count"]) for r in got] == [(150, 70, 3000)]
    rows = docs.select(common.row_key().alias("rk"), "text")
    segs = substring_dedup._segment_rows(rows, 35, None)
    distinct = segs.groupBy("h", "s1", "s2", "n").agg(F.count(F.lit(1)).alias("k"), F.first("words").alias("words"))
    hot = distinct.withColumn("total", F.sum("k").over(Window.partitionBy("h"))).withColumn("hot", F.col("total") > substring_dedup.HOT)
    windows, repeated = substring_dedup._hot_windows(hot, 35)
    assert windows.count() > 3000 and repeated.count() == 36


def plain_components(rows, n, percent):
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = collections.defaultdict(list)
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            ids[r["doc_id"]].append(i)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and None not in (rows[i]["doc_id"], rows[j]["doc_id"]) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return sorted(((r["doc_id"], len(sets[i]), None if r["doc_id"] is None else least[find(i)]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_plain(docs, words, percent):
    got = rows_of(neardup.near_duplicates(docs, words, percent))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_components(rows_of(docs), words, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = rows_of(neardup.near_duplicates(odd, 3, 85))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_components(rows_of(odd), 3, 85)
    assert neardup.near_duplicates(empty).count() == 0


def test_what_the_stars_leave_is_exact(spark, monkeypatch):
    """With a single centre a key, links across components are left to the round by distances."""
    monkeypatch.setattr(neardup, "CENTRES", 1)
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 1)
    monkeypatch.setattr(neardup, "STRAY_BYTES", 4096)
    monkeypatch.setattr(neardup, "OTHER_BYTES", 4096)
    rng = random.Random(17)
    texts = []
    for base in range(3):
        words = [f"b{base}x{i}" for i in range(80)]
        for _ in range(70):
            # a chain: each copy changes the last one, so far ends aren't alike
            words = [w if rng.random() > 0.012 else f"e{rng.randint(0, 9999)}" for w in words]
            texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = rows_of(neardup.near_duplicates(df, 3, 85))
    want = plain_components([{"doc_id": i, "text": t} for i, t in rows], 3, 85)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want
    assert 3 <= len({c for _, _, c in want}) < 120


def test_long_near_duplicates(spark):
    rng = random.Random(23)
    words = [f"v{rng.randint(0, 99999)}" for _ in range(200_000)]
    near, far = list(words), [f"u{i % 70_000}" for i in range(200_000)]
    for i in range(0, 200_000, 400):
        near[i] = "changed"
    texts = [" ".join(words), "\n".join(near).upper(), " ".join(far), " ".join(words[:9])]
    assert len(texts[0]) > 1_000_000
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows_of(neardup.near_duplicates(df, 3, 85))}
    lower = [t.lower().split() for t in texts]
    sets = [len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) for w in lower]
    assert got == {i: (n, 0 if i == 1 else i) for i, n in enumerate(sets)}
    cut = rows_of(substring_dedup.substring_dedup(df, with_text=False))
    assert sorted(((r["row"]["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in cut), key=str) == plain_substrings([{"doc_id": i, "text": t} for i, t in enumerate(texts)], 35)


def test_keys_guarantee_the_threshold():
    """Signatures within THRESHOLD symbols share an index key: some chunk has at most one error."""
    rng = random.Random(1)
    for _ in range(2000):
        wrong = set(rng.sample(range(neardup.CHUNKS * neardup.SYMBOLS), neardup.THRESHOLD))
        assert any(sum(c * 4 + s in wrong for s in range(4)) <= 1 for c in range(neardup.CHUNKS))


def test_symbol_distance(spark):
    rng = random.Random(31)
    rows, want = [], []
    for i in range(300):
        a = [rng.getrandbits(64) for _ in range(neardup.CHUNKS)]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            b[rng.randrange(neardup.CHUNKS)] ^= rng.choice([1, 0x8000, 0xFFFF, 0x0101]) << 16 * rng.randrange(4)
        want.append(sum((x >> 16 * j & 0xFFFF) != (y >> 16 * j & 0xFFFF) for x, y in zip(a, b) for j in range(4)))
        rows.append([i, *(neardup._signed(x) for x in a + b)])
    names = [p + s for p in ("a_", "b_") for s in neardup._SIG]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in ["i", *names]))
    got = df.select("i", neardup.symbol_distance("a_", "b_").alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == want


def test_blocks_are_exact():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    raw = [s.tobytes() for s in sets]
    got = neardup._similar_blocks(raw[:20], raw[20:], 60, width=7)
    for i in range(20):
        for j in range(20):
            a, b = set(sets[i].tolist()), set(sets[20 + j].tolist())
            assert got[i, j] == (100 * len(a & b) >= 60 * len(a | b))


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}


def test_lines_of_odd_rows(odd, empty):
    got = rows_of(line_dedup.line_dedup(odd))
    assert len(got) == odd.count() and all(r["kept_text"] is None for r in got if r["row"]["text"] is None)
    assert line_dedup.line_dedup(empty).count() == 0


def test_neighbouring_steps_share_blocks(spark, monkeypatch):
    """A set is copied for each block of bounded size that it meets, not for each step of distance."""
    monkeypatch.setattr(neardup, "CENTRES", 1)
    monkeypatch.setattr(neardup, "STAR_ROUNDS", 1)
    copied = []
    plain = neardup.common.map_batches

    def counted(rows, *rest):
        if "ob" in rows.columns:
            copied.append((rows.count(), rows.select("hub", "s", "sb", "o", "ob").distinct().count(), rows.select("hub").distinct().count()))
        return plain(rows, *rest)

    monkeypatch.setattr(neardup.common, "map_batches", counted)
    rng = random.Random(17)
    words, texts = [f"x{i}" for i in range(80)], []
    for _ in range(150):
        words = [w if rng.random() > 0.012 else f"e{rng.randint(0, 9999)}" for w in words]
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    got = rows_of(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 85))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == plain_components([{"doc_id": i, "text": t} for i, t in rows], 3, 85)
    [(_, units, hubs)] = copied
    assert units == hubs
