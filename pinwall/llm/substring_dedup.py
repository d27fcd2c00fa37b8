"""Substring dedup: suffix automata of content-routed shards find the spans of a text that occur elsewhere."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinwall.llm import common

#: Windows of so many words; they are routed by the least of the hashes of the GRAM-word runs in them.
WINDOW, GRAM = 35, 8
#: Bits of the filter of repeated runs that tasks get; once it is half full, a merge join takes its place.
FILTER_BITS = common.FILTER_BITS
#: Segments of a shard; occurrences of a run above which its windows are counted before they are dealt.
SHARD, HOT = 400, 256
#: Words of a text that are cut at a time.
WORDS = 1 << 16

_PLACE = np.uint64((1 << 20) - 1)


def sliding(op, x: np.ndarray, width: int) -> np.ndarray:
    """op (minimum or maximum) over all runs of `width`, by doubling."""
    m, have = x, 1
    while have * 2 <= width:
        m, have = op(m[:-have], m[have:]), have * 2
    n = len(x) - width + 1
    return op(m[:n], m[width - have : width - have + n]) if have < width else m


def segments(grams: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last) of runs of the windows at `starts` that share their least gram: every window is in one segment, and equal windows have equal hashes.

    Grams are compared by their upper 44 bits and then by place: that depends on nothing but the window's own words.
    """
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    places = np.arange(len(grams), dtype=np.uint64)
    if len(grams) > int(_PLACE):
        raise ValueError("too many words at once")
    owner = (sliding(np.minimum, (grams & ~_PLACE) | places, window - GRAM + 1) & _PLACE).astype(np.int64)[starts]
    new = np.flatnonzero(np.diff(owner, prepend=-1))
    return grams[owner[new]], starts[new], starts[np.append(new[1:], len(starts)) - 1]


class SuffixAutomaton:
    """Of several word sequences with weights; occurrences() tells which windows of a sequence weigh at least 2 in all."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len, self.weight = [-1], [0], [0]

    def add(self, words: list, weight: int) -> None:
        nxt, link, length, cnt = self.next, self.link, self.len, self.weight
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:
                if length[q] != length[last] + 1:
                    q = self._clone(last, w, q)
                last = q
            else:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                cnt.append(0)
                p = last
                while p >= 0 and w not in nxt[p]:
                    nxt[p][w] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][w]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
                last = cur
            cnt[last] += weight

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        self.weight.append(0)
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def seal(self) -> None:
        """Sums weights from longer to shorter strings; call once after the last add."""
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.weight[self.link[v]] += self.weight[v]

    def repeated(self, words: list, window: int) -> list[int]:
        """Starts of the windows of a sequence whose matching statistic reaches `window` at a place that weighs 2 or more."""
        nxt, link, length = self.next, self.link, self.len
        v, n, out = 0, 0, []
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v, n = nxt[v][w], n + 1
            while v and length[link[v]] >= window:
                v = link[v]
                n = length[v]
            if n >= window and self.weight[v] >= 2:
                out.append(i - window + 1)
        return out


def _items(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[bytes, bytes]]:
    """(first column, text as UTF-8) of batches of (rk, text)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            for rk, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if t:
                    yield rk, t.encode("utf-8", "surrogatepass")


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    made = [c.view(np.int64) if isinstance(c, np.ndarray) and c.dtype == np.uint64 else c for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, schema)], schema=schema)


def _runs(rows: DataFrame, window: int, step: int) -> DataFrame:
    """h: the routing hash of every segment of rows (rk, text)."""
    schema = pa.schema([("h", pa.int64())])

    def run(batches):
        for words in common.word_blocks(_items(batches), window - 1, step):
            if len(starts := words.windows(window)):
                yield _batch(schema, segments(words.hashes().fixed(GRAM), starts, window)[0])

    return common.map_batches(rows, run, "h long")


def _segment_rows(rows: DataFrame, window: int, bits, step: int = common.STEP) -> DataFrame:
    """rk, first (word of the text), n (windows), h, s1, s2 (the segment's own 128 bits), words: segments whose routing hash passes the filter."""
    schema = pa.schema([("rk", pa.binary()), ("first", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for words in common.word_blocks(_items(batches), window - 1, step):
            starts = words.windows(window)
            if not len(starts):
                continue
            one, two = words.hashes(0), words.hashes(1)
            h, first, last = segments(one.fixed(GRAM), starts, window)
            if bits is not None:
                fine = common.passes(bits.value, h)
                h, first, last = h[fine], first[fine], last[fine]
            if len(h):
                end = last + window
                which = np.searchsorted(words.begin, first, side="right") - 1
                place = first - words.begin[which] + np.array([at for _, at in words.tags])[which]
                yield _batch(schema, [words.tags[i][0] for i in which.tolist()], place, last - first + 1, h, one.spans(first, end), two.spans(first, end), words.texts(first, end - 1))

    return common.map_batches(rows, run, "rk binary, first int, n int, h long, s1 long, s2 long, words binary")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """s1, s2, k, i, w1, w2 (the window's 128 bits): every window of segments (s1, s2, k, words)."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("k", pa.int64()), ("i", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64())])

    def run(batches):
        items = (((s1, s2, k), words) for b in batches for s1, s2, k, words in zip(*(c.to_pylist() for c in b.columns)))
        for words in common.word_blocks(items, window - 1):
            if len(starts := words.windows(window)):
                which = np.searchsorted(words.begin, starts, side="right") - 1
                s1, s2, k = (np.array([t[0][c] for t in words.tags], np.int64)[which] for c in range(3))
                yield _batch(schema, s1, s2, k, starts - words.begin[which], words.hashes(0).fixed(window)[starts], words.hashes(1).fixed(window)[starts])

    return common.map_batches(rows, run, "s1 long, s2 long, k long, i int, w1 long, w2 long")


def _stretches(rows: DataFrame, window: int) -> DataFrame:
    """s1, s2, i, words: of segments (s1, s2, words, places) the stretches that their windows at `places` cover."""
    schema = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("i", pa.int32()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            made = []
            for s1, s2, text, places in zip(*(c.to_pylist() for c in batch.columns)):
                words, places = text.split(), sorted(places)
                cuts = [0, *(j for j in range(1, len(places)) if places[j] != places[j - 1] + 1), len(places)]
                made += [(s1, s2, places[a], b" ".join(words[places[a] : places[b - 1] + window])) for a, b in zip(cuts, cuts[1:])]
            if made:
                yield _batch(schema, *zip(*made))

    return common.map_batches(rows, run, "s1 long, s2 long, i int, words binary")


def _matched(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, hot, s1, s2, i, k, words) sorted by shard: hot, s1, s2 and a mask of the segment's windows that occur twice or more."""
    schema = pa.schema([("hot", pa.bool_()), ("s1", pa.int64()), ("s2", pa.int64()), ("mask", pa.int64())])

    def flush(rows):
        sam, ids, seqs = SuffixAutomaton(), {}, []
        for *tag, i, k, text in rows:
            seq = [ids.setdefault(w, len(ids)) for w in text.split()]
            seqs.append((tag, i, seq))
            # two copies tell all that more copies would
            sam.add(seq, min(k, 2))
        sam.seal()
        out = []
        for tag, i, seq in seqs:
            mask = 0
            for s in sam.repeated(seq, window):
                mask |= 1 << (s + i)
            if mask:
                out.append((*tag, mask))
        return _batch(schema, *zip(*out)) if out else None

    shard, rows = None, []
    for batch in batches:
        for s, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if s != shard and rows:
                if made := flush(rows):
                    yield made
                rows = []
            shard = s
            rows.append(row)
    if rows and (made := flush(rows)):
        yield made


def _remover(window: int, with_text: bool, step: int) -> Callable[..., Column]:
    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string, kept_text string")
    def cut(text: pd.Series, firsts: pd.Series, masks: pd.Series) -> pd.DataFrame:
        out = []
        for t, first, mask in zip(text, firsts, masks):
            data = t.encode("utf-8", "surrogatepass") if t else b""
            starts = np.zeros(0, np.int64)
            if first is not None:
                first, mask = np.asarray(first, np.int64), np.asarray(mask, np.int64)
                starts = np.concatenate([first[mask >> i & 1 > 0] + i for i in range(window - GRAM + 1)])
            edge = np.zeros(int(starts.max()) + window + 1 if len(starts) else 0, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + window, -1)
            gone = np.cumsum(edge) > 0
            n, digest, kept = 0, hashlib.sha256(), []
            for at, words in common.word_runs(data, step, 0):
                n = at + len(words)
                here = gone[at:n]
                if here.any():
                    words = [w for w, g in zip(words, here.tolist()) if not g] + words[len(here) :]
                if words:
                    piece = (b" " if kept else b"") + b" ".join(words)
                    digest.update(piece)
                    kept.append(piece if with_text else b"")
            out.append((n, int(gone.sum()), digest.hexdigest(), b"".join(kept).decode("utf-8", "surrogatepass") if with_text else None))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])

    # a filter on its result would have it computed twice
    return cut.asNondeterministic()


def _hot_windows(distinct: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(windows, repeated) of the segments of hot runs: all of their windows, and of those that occur twice or more one row each: w1, w2 and the place (s1, s2, i) that stands for it."""
    windows = common.written(_windows(distinct.where("hot").select("s1", "s2", "k", "words"), window))
    counted = windows.groupBy("w1", "w2").agg(F.sum("k").alias("k"), F.min(F.struct("s1", "s2", "i")).alias("at")).where("k > 1")
    return windows, common.written(counted.select("w1", "w2", "at.*"))


def repeated_windows(rows: DataFrame, window: int = WINDOW, step: int | None = None) -> DataFrame:
    """rk, first, mask: of rows (rk, text) the segments that hold repeated windows; bit i of mask stands for the window that begins at word first + i."""
    spark, step = rows.sparkSession, step or common.STEP
    runs = common.written(_runs(rows, window, step).groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    if runs.count() <= FILTER_BITS // 2:
        bits = spark.sparkContext.broadcast(common.filter_bits(runs, FILTER_BITS))
        segs = _segment_rows(rows, window, bits, step)
    else:
        segs = _segment_rows(rows, window, None, step).join(runs.select("h").hint("merge"), "h", "left_semi")
    segs = common.written(segs, compression="zstd")
    distinct = segs.groupBy("h", "s1", "s2", "n").agg(F.count(F.lit(1)).alias("k"), F.first("words").alias("words"))
    hot = runs.where(F.col("k") > HOT).select("h", F.lit(True).alias("hot"))
    distinct = common.written(distinct.join(hot, "h", "left").withColumn("hot", F.col("hot").isNotNull()), compression="zstd")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(4 * parts, -(-distinct.count() // SHARD))
    dealt = distinct.where("not hot").select(F.pmod("h", F.lit(shards)).alias("shard"), "hot", "s1", "s2", F.lit(0).alias("i"), "k", "words")
    any_hot = not hot.isEmpty()
    if any_hot:
        windows, repeated = _hot_windows(distinct, window)
        places = repeated.groupBy("s1", "s2").agg(F.collect_list("i").alias("places"))
        stretches = _stretches(distinct.where("hot").select("s1", "s2", "words").join(places, ["s1", "s2"]), window)
        # each stands for two occurrences or more
        dealt = dealt.unionByName(stretches.select(F.pmod("s1", F.lit(shards)).alias("shard"), F.lit(True).alias("hot"), "s1", "s2", "i", F.lit(2).cast("long").alias("k"), "words"))
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard")
    found = common.map_batches(dealt, lambda b: _matched(b, window), "hot boolean, s1 long, s2 long, mask long")
    masks = found.groupBy("hot", "s1", "s2").agg(F.bit_or("mask").alias("mask"))
    if any_hot:
        masks = common.written(masks)
        places = F.expr(f"filter(sequence(0, {window - GRAM}), i -> (mask & shiftleft(1L, i)) <> 0)")
        confirmed = masks.where("hot").select("s1", "s2", F.explode(places).alias("i")).join(repeated, ["s1", "s2", "i"]).select("w1", "w2")
        # a window that most segments hold is a frequent key against one row, which Spark splits
        of_hot = windows.join(confirmed.hint("merge"), ["w1", "w2"]).groupBy("s1", "s2").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
        masks = masks.where("not hot").select("s1", "s2", "mask").unionByName(of_hot)
    masks = common.written(masks.select("s1", "s2", "mask"))
    return segs.select("rk", "first", "s1", "s2").join(masks.hint("merge"), ["s1", "s2"]).select("rk", "first", "mask")


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """row (a struct of all input columns), n_words, n_removed, kept_sha256, kept_text: one row for each input row.

    A word goes if a window of `window` consecutive words that covers it starts anywhere else
    too, in this row or another (equal rows are different places). kept_text has the kept words
    joined by one space (null without with_text). Null, empty and shorter texts lose nothing.
    A text of any length is looked at in overlapping stretches of common.STEP bytes.

    Every window belongs to the leftmost of its least GRAM-word runs, so equal windows meet at
    one run's hash. Runs are counted over the corpus; segments of windows whose run is repeated
    are collapsed to distinct ones with multiplicities and routed by run to shards of bounded
    size. A shard's suffix automaton is built in the task to which its segments are sent, which
    then streams them for their matching statistics. A run with more than HOT occurrences has
    its windows counted by hash first (sums before the shuffle); one stretch for each distinct
    repeated window is dealt by its own hash, so that no run and no window gathers in one task.
    Segments and windows are told apart by 128-bit hashes; words are compared by the automata.
    """
    if not GRAM < window < GRAM + 63:
        raise ValueError(f"window must be between {GRAM + 1} and {GRAM + 62} words")
    rows = docs.select(common.row_key(key, text).alias("rk"), F.col(text).cast("string").alias("text"))
    # equal rows have equal marks; one of them is enough, however often the row is repeated
    marks = repeated_windows(rows, window).distinct().groupBy("rk").agg(F.collect_list(F.struct("first", "mask")).alias("marks"))
    marks = marks.select("rk", F.col("marks.first").alias("firsts"), F.col("marks.mask").alias("masks"))
    full = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), common.row_key(key, text).alias("rk"))
    cut = _remover(window, with_text, WORDS)(F.col(f"row.`{text}`").cast("string"), F.col("firsts"), F.col("masks"))
    out = full.join(common.written(marks).hint("merge"), "rk", "left").select("row", cut.alias("cut"))
    return out.select("row", "cut.n_words", "cut.n_removed", "cut.kept_sha256", "cut.kept_text")


def op3_substring_dedup(spark, sf_dir):
    """Words of `documents` outside repeated windows of 35 words."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs, with_text=False).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


OP3_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, pos, md5(array_to_string(ws[pos : pos + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS pos FROM d WHERE len(ws) >= 35)),
r AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS i FROM r),
l AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
k AS (SELECT l.doc_id, count(*) AS n_words, count(c.i) AS n_removed, string_agg(l.word, ' ' ORDER BY l.i) FILTER (WHERE c.i IS NULL) AS kept
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
