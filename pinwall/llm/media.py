"""Media columns: a FLAC codec in numpy; frames are checked, decoded and listed as PCM blocks with their sample offsets."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pinwall.llm import common

#: Samples in each frame but the last.
BLOCK = 4096
RATE = 8000
#: The payload of a text is padded to a positive multiple of so many bytes.
PAD = 64


class FlacError(ValueError):
    """The stream is damaged or uses what the format reserves."""


# ---------------------------------------------------------------- checksums


def _crc_table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for byte in range(256):
        r = byte << (width - 8)
        for _ in range(8):
            r = ((r << 1) ^ poly if r & top else r << 1) & mask
        out.append(r)
    return np.array(out, np.uint16)


_CRC8 = _crc_table(0x07, 8).tolist()
_CRC16 = _crc_table(0x8005, 16)
#: _FAR[256 * (4095 - j) + b]: what byte b contributes to the CRC-16 when j bytes follow it (a CRC that starts from 0 is linear).
_FAR: list[np.ndarray] = []
_ROW = np.arange(4096) * 256


def crc8(data: bytes) -> int:
    r = 0
    for b in data:
        r = _CRC8[r ^ b]
    return r


def crc16(data: np.ndarray) -> int:
    """Of bytes as uint8: chunks of 4096 by table rows, each chunk's start state folded into its first two bytes."""
    if not _FAR:
        rows = [_CRC16]
        for _ in range(4095):
            rows.append((rows[-1] << np.uint16(8)) ^ _CRC16[rows[-1] >> np.uint16(8)])
        _FAR.append(np.concatenate(rows[::-1]))
    far, r = _FAR[0], 0
    for at in range(0, len(data), 4096):
        part = data[at : at + 4096]
        if r:
            part = part.copy()
            part[0] ^= r >> 8
            if len(part) == 1:
                return int(_CRC16[part[0]]) ^ ((r & 255) << 8)
            part[1] ^= r & 255
        r = int(np.bitwise_xor.reduce(far[_ROW[4096 - len(part) :] + part]))
    return r


# ---------------------------------------------------------------- encoder


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form of frame headers."""
    if n < 128:
        return bytes([n])
    tail = []
    lead = 0x3F
    while n > lead:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead >>= 1
    return bytes([(0xFE << (len(str(bin(lead))) - 2)) & 0xFF | n, *reversed(tail)])


def _rice_bits(res: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Bits, Rice parameter and folded residuals of the cheapest parameter."""
    u = ((res << 1) ^ (res >> 31)).astype(np.int64)
    n, total = len(u), int(u.sum())
    first = max(0, min(14, int(total / max(n, 1) * 0.7 + 1).bit_length() - 1))
    best = min(((n * (k + 1) + int((u >> k).sum()), k) for k in {max(0, first - 1), first, min(14, first + 1)}))
    return *best, u


def _frame(x: np.ndarray, number: int) -> bytes:
    n = len(x)
    head = b"\xff\xf8\x74\x02" + _number(number) + (n - 1).to_bytes(2, "big")
    head += bytes([crc8(head)])
    if n and (x == x[0]).all():
        body = np.array([0, x[0] & 255], np.uint8).tobytes()
    else:
        tried = []
        r = x
        for order in range(min(3, n)):
            tried.append((int(np.abs(r).sum()), order, r))
            r = np.diff(r)
        _, order, r = min(tried, key=lambda t: t[:2])
        size, k, u = _rice_bits(r)
        if 10 + 8 * order + size >= 8 * n:
            body = b"\x02" + (x & 255).astype(np.uint8).tobytes()
        else:
            lead = 8 + 8 * order + 10
            bits = np.zeros(-(-(lead + size) // 8) * 8, np.uint8)
            start = bytes([0x10 | order << 1]) + (x[:order] & 255).astype(np.uint8).tobytes() + (k << 6).to_bytes(2, "big")
            bits[:lead] = np.unpackbits(np.frombuffer(start, np.uint8))[:lead]
            q = u >> k
            stop = np.cumsum(q + (1 + k)) + (lead - 1 - k)
            bits[stop] = 1
            for j in range(k):
                bits[stop + (1 + j)] = (u >> (k - 1 - j)) & 1
            body = np.packbits(bits).tobytes()
    raw = head + body
    return raw + crc16(np.frombuffer(raw, np.uint8)).to_bytes(2, "big")


def encode(pcm: np.ndarray, block: int = BLOCK) -> bytes:
    """A mono stream of signed 8-bit samples: fixed predictors of order 0 to 2 with Rice residuals, or verbatim where that is shorter; one seek point a frame."""
    x = pcm.astype(np.int32)
    frames = [_frame(x[at : at + block], i) for i, at in enumerate(range(0, len(x), block))]
    sizes = [len(f) for f in frames] or [0]
    info = block.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(x)).to_bytes(8, "big") + hashlib.md5(pcm.astype(np.int8).tobytes()).digest()
    seek, offset = b"", 0
    for i, f in enumerate(frames):
        seek += (i * block).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(block, len(x) - i * block).to_bytes(2, "big")
        offset += len(f)
    return b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(frames)


# ---------------------------------------------------------------- decoder


class _Bits:
    """The unpacked bits of one frame and a position in them."""

    def __init__(self, data: np.ndarray):
        self.bits, self.at = np.unpackbits(data), 0

    def take(self, n: int) -> int:
        got = self.bits[self.at : self.at + n]
        if len(got) < n:
            raise FlacError("the stream ends inside a frame")
        self.at += n
        return int.from_bytes(np.packbits(got).tobytes(), "big") >> (-n % 8)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def raw(self, count: int, width: int) -> np.ndarray:
        """`count` signed numbers of `width` bits."""
        if not width or not count:
            return np.zeros(count, np.int64)
        got = self.bits[self.at : self.at + count * width]
        if len(got) < count * width:
            raise FlacError("the stream ends inside a frame")
        self.at += count * width
        v = got.reshape(count, width) @ (np.int64(1) << np.arange(width - 1, -1, -1))
        return v - ((v >> (width - 1)) << width)

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n

    def rice(self, count: int, k: int) -> np.ndarray:
        """`count` residuals. A code ends k bits after its first one-bit, so codes form a chain through the one-bits:
        jumps over 1, 2, 4, 8 and 16 codes are tabled for all of them, only each 16th code is walked to, and the
        tables fill in the rest."""
        if not count:
            return np.zeros(0, np.int64)
        bits = self.bits[self.at :]
        n = len(bits)
        ones = np.flatnonzero(bits)
        m = len(ones)
        before = np.empty(n + 1, np.intp)
        before[0] = 0
        np.cumsum(bits, out=before[1:])
        jump = np.full(m + 1, m, np.intp)
        jump[:m] = before.take(ones + (1 + k), mode="clip")
        jumps = [jump]
        while len(jumps) < 5 and count >> len(jumps):
            jumps.append(jumps[-1].take(jumps[-1]))
        far, chain = memoryview(jumps[-1]), [0]
        for _ in range((count - 1) >> (len(jumps) - 1)):
            chain.append(far[chain[-1]])
        which = np.array(chain, np.intp)
        for table in reversed(jumps[:-1]):
            both = np.empty(2 * len(which), np.intp)
            both[::2] = which
            both[1::2] = table.take(which)
            which = both
        which = which[:count]
        if which[-1] >= m or ones[which[-1]] + k >= n:
            raise FlacError("the stream ends inside a frame")
        ends = ones.take(which)
        at = np.empty(count, np.intp)
        at[0] = 0
        at[1:] = ends[:-1] + (1 + k)
        u = ends - at
        for j in range(1, k + 1):
            u <<= 1
            u |= bits.take(ends + j)
        self.at += int(ends[-1]) + 1 + k
        return (u >> 1) ^ -(u & 1)


def _residuals(b: _Bits, n: int, order: int) -> np.ndarray:
    method = b.take(2)
    if method > 1:
        raise FlacError("reserved residual coding")
    width = 5 if method else 4
    parts = b.take(4)
    each = n >> parts
    if each << parts != n or each < order:
        raise FlacError("partitions don't divide the block")
    out = []
    for i in range(1 << parts):
        count, k = each - (0 if i else order), b.take(width)
        out.append(b.raw(count, b.take(5)) if k == (1 << width) - 1 else b.rice(count, k))
    return np.concatenate(out)


def _subframe(b: _Bits, n: int, depth: int) -> np.ndarray:
    if b.take(1):
        raise FlacError("a subframe begins with a zero bit")
    kind = b.take(6)
    wasted = b.unary() + 1 if b.take(1) else 0
    depth -= wasted
    if kind == 0:
        x = np.full(n, b.signed(depth), np.int64)
    elif kind == 1:
        x = b.raw(n, depth)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = b.raw(order, depth)
        x = _residuals(b, n, order)
        for level in range(order, 0, -1):
            # the first value of the difference sequence one level down, then running sums
            x = np.concatenate([np.diff(warm, level - 1)[:1], x]).cumsum()
    elif kind >= 32:
        order = kind - 31
        warm = b.raw(order, depth).tolist()
        precision = b.take(4) + 1
        shift = b.signed(5)
        if precision == 16 or shift < 0:
            raise FlacError("reserved predictor")
        taps = b.raw(order, precision).tolist()
        line = warm
        for e in _residuals(b, n, order).tolist():
            line.append(e + (sum(c * v for c, v in zip(taps, line[: -order - 1 : -1])) >> shift))
        x = np.array(line, np.int64)
    else:
        raise FlacError("reserved subframe type")
    return x << wasted


@dataclass
class Block:
    """A decoded frame: pcm has a row for each sample and a column for each channel."""

    index: int
    sample_offset: int
    byte_offset: int
    pcm: np.ndarray
    depth: int


_DEPTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _read_frame(data: np.ndarray, info: dict) -> tuple[np.ndarray, int, int]:
    """The samples of the frame that data begins with, its length in bytes, its sample depth."""
    raw = data[:16].tobytes()
    if len(raw) < 6 or raw[0] != 0xFF or raw[1] & 0xFE != 0xF8:
        raise FlacError("no frame here")
    size, rate, layout, depth = raw[2] >> 4, raw[2] & 15, raw[3] >> 4, raw[3] >> 1 & 7
    lead = raw[4]
    extra = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
    at = 5 + extra
    if size == 0 or rate == 15 or layout > 10 or depth == 3:
        raise FlacError("reserved frame header")
    if size in (6, 7):
        n = int.from_bytes(raw[at : at + size - 5], "big") + 1
        at += size - 5
    else:
        n = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if len(raw) <= at or crc8(raw[:at]) != raw[at]:
        raise FlacError("a frame header's checksum is wrong")
    at += 1
    bps = _DEPTHS.get(depth, info["depth"])
    b = _Bits(data[at:])
    channels = layout + 1 if layout < 8 else 2
    side = {8: 1, 9: 0, 10: 1}.get(layout)
    lines = [_subframe(b, n, bps + (c == side)) for c in range(channels)]
    if layout == 8:
        lines[1] = lines[0] - lines[1]
    elif layout == 9:
        lines[0] = lines[0] + lines[1]
    elif layout == 10:
        mid = lines[0] << 1 | lines[1] & 1
        lines = [(mid + lines[1]) >> 1, (mid - lines[1]) >> 1]
    end = at + -(-b.at // 8)
    if len(data) < end + 2 or crc16(data[:end]) != int.from_bytes(data[end : end + 2].tobytes(), "big"):
        raise FlacError("a frame's checksum is wrong")
    return np.stack(lines, axis=1), end + 2, bps


def stream_info(media: bytes) -> dict:
    """What the metadata say: block sizes, rate, channels, depth, samples, md5, seek points (sample, byte, samples) and where frames begin."""
    if media[:4] != b"fLaC":
        raise FlacError("not a FLAC stream")
    at, last, info = 4, False, {"seek": []}
    while not last:
        if len(media) < at + 4:
            raise FlacError("the stream ends inside its metadata")
        last, kind, n = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            info |= {"block": int.from_bytes(body[2:4], "big"), "frame_bytes": int.from_bytes(body[7:10], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "depth": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            info["seek"] = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, n, 18)]
        at += 4 + n
    if "depth" not in info:
        raise FlacError("no stream information")
    return info | {"frames_at": at}


def read_blocks(media: bytes, from_sample: int = 0) -> Iterator[Block]:
    """The blocks from the one that holds from_sample on, each checked against its frame's checksums; a seek point is used where there is one."""
    info = stream_info(media)
    data = np.frombuffer(media, np.uint8)
    at, sample, index = info["frames_at"], 0, 0
    points = [(i, s, o) for i, (s, o, _) in enumerate(info["seek"]) if s <= from_sample and s != (1 << 64) - 1]
    if points and from_sample:
        index, sample, offset = points[-1]
        at += offset
    while at < len(data):
        # a frame is at most frame_bytes long where the encoder says so; more is not unpacked
        pcm, size, depth = _read_frame(data[at : at + info["frame_bytes"]] if info["frame_bytes"] else data[at:], info)
        if sample + len(pcm) > from_sample:
            yield Block(index, sample, at - info["frames_at"], pcm, depth)
        at, sample, index = at + size, sample + len(pcm), index + 1


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % PAD if raw else PAD)


def to_samples(payload: bytes) -> np.ndarray:
    return (np.frombuffer(payload, np.uint8) ^ 128).view(np.int8)


def from_samples(pcm: np.ndarray) -> bytes:
    return (pcm.astype(np.int8).view(np.uint8) ^ 128).tobytes()


def features(pcm: np.ndarray) -> str:
    """Peak, root mean square, zero crossings a sample and mean step of the first channel."""
    x = pcm.astype(np.int64)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    n = max(len(x), 1)
    return f"peak={int(np.abs(x).max(initial=0))};rms={(int((x * x).sum()) / n) ** 0.5:.4f};zcr={crossings / n:.6f};step={int(np.abs(np.diff(x)).sum()) / n:.4f}"


# ---------------------------------------------------------------- DataFrames


def encode_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes (unpadded UTF-8) and media: each whole text stored as a FLAC stream; null counts as empty, an empty text is PAD zero bytes."""

    def make():
        def each(cols):
            return {
                "key": cols["key"],
                "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in cols["text"]],
                "media": [encode(to_samples(payload_of(t))) for t in cols["text"]],
            }

        return each

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    out = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return common.over_rows(rows, "key long, n_bytes long, media binary", out, make, rows=256).withColumnRenamed("key", key)


def decode_blocks(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """One row for each block of each stream: key, block, sample_offset, byte_offset, n_samples, error, pcm (interleaved, one byte a sample up to 8 bits, else four).

    Null streams have no blocks. A damaged stream gives the blocks before the damage and a
    row whose error says what is wrong, with null pcm; other streams are not touched.
    """

    def run(batches):
        out = pa.schema([("key", pa.int64()), ("block", pa.int64()), ("sample_offset", pa.int64()), ("byte_offset", pa.int64()), ("n_samples", pa.int64()), ("error", pa.string()), ("pcm", pa.binary())])
        for batch in batches:
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                try:
                    for x in read_blocks(m.as_py()) if m.is_valid else ():
                        rows.append((k, x.index, x.sample_offset, x.byte_offset, len(x.pcm), None, x.pcm.astype(np.int8 if x.depth <= 8 else "<i4").tobytes()))
                except FlacError as e:
                    rows.append((k, len(rows), None, None, None, str(e), None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    rows = media.select(F.col(key).cast("long").alias("key"), F.col(column).alias("media"))
    made = rows.mapInArrow(run, "key long, block long, sample_offset long, byte_offset long, n_samples long, error string, pcm binary")
    return made.withColumnRenamed("key", key)


def digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Figures of each stored text as read back block by block; the stream's md5 must hold."""

    def make():
        def each(cols):
            out = {n: [] for n in ("key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_blocks")}
            for k, n, m in zip(cols["key"], cols["n_bytes"], cols["media"]):
                pcm = [b.pcm[:, 0] for b in read_blocks(m)]
                x = np.concatenate(pcm)
                payload = from_samples(x)
                if hashlib.md5(x.astype(np.int8).tobytes()).digest() != stream_info(m)["md5"]:
                    raise FlacError("the samples' md5 is wrong")
                row = (k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), features(x), len(pcm))
                for name, v in zip(out, row):
                    out[name].append(v)
            return out

        return each

    out = pa.schema([("key", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_blocks", pa.int64())])
    schema = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long"
    return common.over_rows(media.select(F.col(key).alias("key"), "n_bytes", "media"), schema, out, make, rows=256).withColumnRenamed("key", key)


def op7_media_columns(spark, sf_dir):
    """Every text of `documents` stored as FLAC and read back."""
    return digest(encode_texts(common.table(spark, sf_dir, "documents")))
