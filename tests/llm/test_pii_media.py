"""Personal data against the plain patterns, and the codec's round trips and checks."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from pinwall.llm import media, pii

EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(s):
    digits = lambda m: sum(c.isdigit() for c in m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(s)],
        "ip": [m.span() for m in IP.finditer(s) if all(int(q) <= 255 for q in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(s) if 12 <= digits(m) <= 19 and pii.luhn(re.sub("[ -]", "", m[0]))],
        "phone": [m.span() for m in PHONE.finditer(s) if 9 <= digits(m) <= 15],
    }


@given(st.text(alphabet="ab1234.@+-() %9", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans_are_the_patterns(s):
    assert pii.base_spans(s) == plain(s)


def test_long_runs_are_linear():
    for s in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1 " + "(" * 200_000, "0" * 5000 + ".1.2.3"):
        pii.spans(s)


def test_checks_and_context():
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE89 3704 0044 0532 0130 01")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda s: [k for _, _, k, _ in pii.spans(s)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == ["iban"]
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("ref 123-45-6789") == []
    assert kinds("call 555-123-4567") == ["tel"] and kinds("call +1 (555) 123-4567") == ["phone"]
    assert pii.redact("mail a@b.co, tel +1 555 123 4567!") == "mail [email], tel [phone]!" and pii.redact(None) is None


def test_find_pii_frames(spark, odd, empty):
    df = spark.createDataFrame([(1, "é a@b.co 10.0.0.1"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["found"]] for r in rows_of(pii.find_pii(df))}
    assert got == {1: [("email", 2, 8), ("ip", 9, 17)], 2: [], 3: []}
    assert pii.find_pii(odd).count() == odd.count() and pii.find_pii(empty).count() == 0


@given(st.integers(0, 1 << 30), st.integers(0, 9000), st.sampled_from(["noise", "walk", "flat", "text"]))
@settings(max_examples=60, deadline=None)
def test_codec_round_trip(seed, n, kind):
    rng = np.random.default_rng(seed)
    a = {"noise": rng.integers(-128, 128, n), "walk": (rng.integers(-2, 3, n).cumsum() + 128) % 256 - 128, "flat": np.full(n, int(rng.integers(-128, 128))), "text": rng.integers(97, 123, n) - 128}[kind].astype(np.int8)
    stream = media.encode(a)
    blocks = list(media.read_blocks(stream))
    got = np.concatenate([b.pcm[:, 0] for b in blocks]) if blocks else np.zeros(0)
    assert (got == a).all() and len(got) == n and media.stream_info(stream)["samples"] == n
    if n > 4500:
        later = list(media.read_blocks(stream, 4500))
        assert later[0].sample_offset == 4096 and later[0].index == 1 and (later[0].pcm[:, 0] == a[4096:8192]).all()


def test_damage_is_found(spark):
    stream = bytearray(media.encode(np.arange(10_000).astype(np.int8)))
    stream[-20] ^= 4
    with pytest.raises(media.FlacError):
        list(media.read_blocks(bytes(stream)))
    for cut in (3, 30, len(stream) // 2):
        with pytest.raises(media.FlacError):
            list(media.read_blocks(bytes(stream[:cut])))
    good = media.encode(np.zeros(64, np.int8))
    df = spark.createDataFrame([(1, bytes(stream)), (2, good), (3, None), (4, b"junk")], "doc_id long, media binary")
    got = rows_of(media.decode_blocks(df).orderBy("doc_id", "block"))
    assert [(r["doc_id"], r["error"] is None) for r in got] == [(1, True), (1, True), (1, False), (2, True), (4, False)]
    assert [r["sample_offset"] for r in got[:2]] == [0, 4096] and len(got[3]["pcm"]) == 64


def _bits(*fields):
    return "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields)


def _wrapped(body, n, layout=0, size_code=0b0110, depth=0b001):
    """A frame of n samples from the bits of its subframes."""
    head = b"\xff\xf8" + bytes([size_code << 4 | 4, layout << 4 | depth << 1]) + b"\x00" + bytes([n - 1])
    raw = head + bytes([media.crc8(head)]) + int(body + "0" * (-len(body) % 8), 2).to_bytes(-(-len(body) // 8), "big")
    return raw + media.crc16(np.frombuffer(raw, np.uint8)).to_bytes(2, "big")


def _stream(frame):
    info = bytes.fromhex("00100010" + "000000" * 2) + (8000 << 44 | 7 << 36).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80\x00\x00\x22" + info + frame


def _rice(res, k):
    out = ""
    for r in res:
        u = r << 1 if r >= 0 else (-r << 1) - 1
        out += "0" * (u >> k) + "1" + (format(u & ((1 << k) - 1), f"0{k}b") if k else "")
    return out


def test_foreign_subframes():
    x = [3, 5, 8, 10, 14, 13, 11, 12, 15, 20, 22, 21, 19, 18, 18, 17]
    taps, shift = [7, -3], 2
    res = [x[i] - ((taps[0] * x[i - 1] + taps[1] * x[i - 2]) >> shift) for i in range(2, 16)]
    lpc = _bits((0, 1), (32 + 1, 6), (0, 1), (x[0], 8), (x[1], 8), (4, 4), (shift, 5), (taps[0], 5), (taps[1], 5), (0, 2), (1, 4), (1, 4)) + _rice(res[:6], 1) + _bits((2, 4)) + _rice(res[6:], 2)
    cubic = np.diff(x, 3).tolist()
    fixed = _bits((0, 1), (8 + 3, 6), (0, 1), (x[0], 8), (x[1], 8), (x[2], 8), (1, 2), (0, 4), (31, 5), (7, 5)) + _bits(*((r, 7) for r in cubic))
    wasted = _bits((0, 1), (1, 6), (1, 1)) + "1" + _bits(*((v, 7) for v in x))
    for body, want in ((lpc, x), (fixed, x), (wasted, [2 * v for v in x])):
        (block,) = media.read_blocks(_stream(_wrapped(body, 16)))
        assert block.pcm[:, 0].tolist() == want
    left, right = np.array(x), np.array(x[::-1])
    plain = lambda v, n: _bits((0, 1), (1, 6), (0, 1)) + _bits(*((int(s), n) for s in v))
    for layout, a, b, na, nb in ((1, left, right, 8, 8), (8, left, left - right, 8, 9), (9, left - right, right, 9, 8), (10, (left + right) >> 1, left - right, 8, 9)):
        (block,) = media.read_blocks(_stream(_wrapped(plain(a, na) + plain(b, nb), 16, layout)))
        assert (block.pcm == np.stack([left, right], 1)).all()


def test_text_digest(odd, empty):
    rows = rows_of(odd.select("doc_id", "text"))
    got = rows_of(media.digest(media.encode_texts(odd)))
    want = []
    for r in rows:
        raw = (r["text"] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")) for r in got), key=str) == sorted(want, key=str)
    assert media.digest(media.encode_texts(empty)).count() == 0
