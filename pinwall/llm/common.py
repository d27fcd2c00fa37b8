"""What the corpus operators share: words, row keys, checkpoints and Arrow passes."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but space, tab, LF, VT, FF and CR.
#: bytes.split() separates at exactly these six bytes.
WORD_REGEX = r"[^\x20\x09-\x0D]+"
#: Bytes of texts that are looked at together.
STEP = 1 << 19


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_runs(data: bytes, step: int, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, words): runs of `step` words that overlap by `overlap`, so that a long text's words are never all alive at once."""
    at, head = 0, []
    while True:
        got = data.split(None, step)
        data = got.pop() if len(got) > step else b""
        head += got
        if not data:
            if at == 0 or len(head) > overlap:
                yield at, head
            return
        yield at, head
        at += len(head) - overlap
        head = head[len(head) - overlap :]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Random numbers of bytes, and bases of two polynomial hashes modulo 2^64.
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64; short blocks share one table."""
    got = _POWERS.get(which)
    if got is None or len(got[0]) < n:
        both = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            p = np.full(max(n, STEP + 1), b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        got = tuple(both)
        if n <= 4 * STEP:
            _POWERS[which] = got
    return got


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class RunHashes:
    """64-bit hashes of all runs of a sequence of numbers by prefix sums; `which` of two independent ones."""

    def __init__(self, x: np.ndarray, which: int = 0):
        up, self.down = _powers(which, len(x) + 1)
        self.sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=self.sums[1:])

    def fixed(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mixed((self.sums[k:] - self.sums[:-k]) * self.down[:n])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Words:
    """The words of some texts: where they begin and end in data, where the words of each text begin among them, and the texts' tags."""

    def __init__(self, parts: list[bytes], tags: list):
        self.data, self.tags = b"\n".join(parts), tags
        self.bytes = np.frombuffer(self.data, np.uint8)
        edge = np.diff(np.concatenate([[True], _SPACE[self.bytes], [True]]).view(np.int8))
        self.start, self.end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        self.begin = np.searchsorted(self.start, at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, which: int = 0) -> RunHashes:
        """Of runs of words."""
        return RunHashes(RunHashes(_BYTES[which][self.bytes], which).spans(self.start, self.end), which)

    def windows(self, width: int) -> np.ndarray:
        """First words of the runs of `width` words that lie within one text."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        edge = np.zeros(len(self) + 1, np.int64)
        np.add.at(edge, np.maximum(self.begin[1:] - width + 1, 0), 1)
        np.add.at(edge, self.begin[1:], -1)
        return np.flatnonzero(np.cumsum(edge[:n]) == 0)

    def texts(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        """From the first to the last word (inclusive), with what stands between them."""
        return [self.data[i:j] for i, j in zip(self.start[first].tolist(), self.end[last].tolist())]


def word_blocks(items: Iterable[tuple], overlap: int, step: int = STEP) -> Iterator[Words]:
    """Words of items (tag, data) of about `step` bytes together, tagged (tag, place of the first word in the text).

    A text of more bytes comes in stretches of its own that overlap by `overlap` words, so that each run of overlap + 1 words is in one of them.
    """
    parts, tags, size = [], [], 0
    for tag, data in items:
        if len(data) > step:
            yield from stretches(tag, data, overlap, step)
            continue
        parts.append(data)
        tags.append((tag, 0))
        size += len(data) + 1
        if size >= step:
            yield Words(parts, tags)
            parts, tags, size = [], [], 0
    if parts:
        yield Words(parts, tags)


def stretches(tag, data: bytes, overlap: int, step: int = STEP) -> Iterator[Words]:
    """One text in stretches of about `step` bytes, as in word_blocks."""
    at, place, size = 0, 0, step
    while True:
        end = at + size
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        got = Words([data[at:end]], [(tag, place)])
        if end < len(data) and len(got) <= 2 * overlap:
            # words of such length that little is gained
            size *= 2
            continue
        yield got
        if end >= len(data):
            return
        place += len(got) - overlap
        at = at + int(got.start[-overlap]) if overlap else end
        size = step


#: Bits of a filter that tasks get: its size is fixed, so a full one only lets more through.
FILTER_BITS = 1 << 26


def filter_bits(wanted: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """`size` bits as numbers of 64, set for the 64-bit hashes in column h."""
    slot = F.col("h").bitwiseAND(F.lit(size - 1))
    # shiftleft takes its amount from the row
    words = wanted.select(F.shiftright(slot, 6).alias("i"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    got = words.toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[got.column("i").to_numpy()] = got.column("b").to_numpy()
    return bits.view(np.uint64)


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & np.uint64(64 * len(bits) - 1)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNTOUCHED = "67108864b"


def bounded_batches(spark: SparkSession) -> None:
    """Batches of 8 MB between the JVM and Python workers, unless the session says otherwise: each side of each running task holds one or two."""
    if spark.conf.get(_BATCH, _UNTOUCHED) == _UNTOUCHED:
        spark.conf.set(_BATCH, "8m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """16 bytes that tell rows apart that share a doc_id but not a text; equal rows may share all that is derived from them."""
    key = F.col(doc_id).cast("string")
    known = F.coalesce(F.concat(F.length(key), F.lit(":"), key), F.lit("-"))
    return F.unhex(F.md5(F.concat(known, F.coalesce(F.concat(F.lit("+"), F.col(text).cast("string")), F.lit("-")))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pinwall-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: One folder for each driver process, below the shared one.
_RUN = uuid.uuid4().hex
_FOLDERS: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    """Tables of written() go when the driver ends; what a lost driver leaves is below pinwall/ in the shared folder."""
    for folder, spark in _FOLDERS.items():
        try:
            _delete(spark, folder)
        except Exception:  # noqa: BLE001 - the session may have been stopped already
            pass


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    bounded_batches(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/pinwall/{_RUN}"
    _FOLDERS[folder] = spark
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes tables of written() that nothing will read again."""
    for df in frames:
        path = vars(df).pop("written_at", None) if df is not None else None
        if path:
            _delete(df.sparkSession, path)


def release() -> None:
    """Hands memory that a worker no longer uses back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow that releases the worker's memory when a task ends."""

    def released(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(released, schema)


def over_rows(
    df: DataFrame,
    schema: str,
    out: pa.Schema,
    make: Callable[[], Callable[[dict[str, list]], dict[str, list] | list[dict[str, list]]]],
    rows: int = 512,
) -> DataFrame:
    """mapInArrow over slices of `rows` rows: make() is called once a task and returns the function from columns to columns.

    Slices bound the Python objects alive at a time; long texts are never cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                made = each({n: piece.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return map_batches(df, run, schema)
