"""Token ids of a public tokenizer, encoded once for each distinct pre-token; of many texts at once in numpy.

The normaliser and the pre-tokeniser of the vocabulary never join characters across
ASCII white space (which it drops), so a text's ids are the concatenation of its chunks'
ids; ``tests/llm`` holds this against the tokenizer on whole texts.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

DEFAULT_TOKENIZER = "word_bpe_49k.json"


def default_path() -> str:
    return public_tokenizers.path(DEFAULT_TOKENIZER)


#: What isn't a blank or a character whose normal form, lower case and letter class are the same everywhere (printable
#: ASCII and Latin-1 letters), or may begin a special token.
_ODD = re.compile("[^!-~\u00c0-\u00ff \n]|<\\|", re.ASCII)
#: The vocabulary's pre-tokens of texts of such characters in lower case; U+00D7 and U+00F7 are no letters.
_PRETOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9 \n]+")


def _byte_alphabet() -> dict[int, str]:
    """Byte -> the character that byte-level vocabularies write for it: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Bytes of texts (Latin-1) that are encoded together, and of pre-tokens that are merged in numpy; longer ones go through ChunkEncoder.
STEP, WIDE = 1 << 21, 16
#: Latin-1 bytes of texts without _ODD characters, and their lower case.
_EVEN = bytes([10, 32, *range(0x21, 0x7F), *range(0xC0, 0x100)])
_LOWER = bytes(ord(chr(b).lower()) for b in range(256))
#: What a byte in lower case is to _PRETOKEN: 0 blank, 1 letter, 2 digit, 3 other.
_KIND = np.full(256, 3, np.uint8)
_KIND[[10, 32]] = 0
_KIND[[*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_ENDING = re.compile(b"'(?:s|t|re|ve|m|ll|d)")


def _pretokens(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of _PRETOKEN in bytes of lower case begin and end."""
    b = np.frombuffer(low, np.uint8)
    kind = _KIND[b]
    edge = np.ones(len(b) + 1, bool)
    edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    # an apostrophe that begins a match takes its ending along
    for found in _ENDING.finditer(low):
        if edge[found.start()]:
            edge[found.start() + 1], edge[found.end()] = False, True
    start = np.flatnonzero(edge)
    end, start = start[1:], start[:-1]
    shown = kind[start] > 0
    return start[shown], end[shown]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of the next."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


class Merges:
    """Byte pair merges of the vocabulary for many words at once: the least rank first, of equal ones the leftmost, as its model does."""

    NONE = 0xFFFF
    BITS = 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if max(*vocab.values(), len(pairs)) >= self.NONE:
            raise ValueError("ids and ranks must fit 16 bits")
        # tables of slots: a pair whose slot another one takes is in the next table
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        left, self.tables = np.arange(len(key)), []
        while len(left):
            factor = np.uint32(0x9E3779B1 + 2 * len(self.tables) * 0x27D4EB2F & 0xFFFFFFFF)
            keys, rank = np.zeros(1 << self.BITS, np.uint32), np.full(1 << self.BITS, self.NONE, np.uint16)
            slot = self._slot(key[left], factor)
            keys[slot], rank[slot] = key[left], left
            self.tables.append((factor, keys, rank))
            left = left[keys[slot] != key[left]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint16)
        alphabet = _byte_alphabet()
        self.first = np.array([[vocab[alphabet[b]] for b in range(256)], [vocab[alphabet[b] + end] for b in range(256)]], np.uint16)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint32) << np.uint32(16) | b
        got = np.full(len(key), self.NONE, np.uint16)
        todo = np.arange(len(key))
        for factor, keys, rank in self.tables:
            slot = self._slot(key, factor)
            held, found = keys[slot], rank[slot]
            hit = held == key
            got[todo[hit]] = found[hit]
            # an empty slot ends the search
            more = np.flatnonzero(~hit & (found < self.NONE))
            todo, key = todo[more], key[more]
        return got

    def _slot(self, key: np.ndarray, factor: np.uint32) -> np.ndarray:
        return key * factor >> np.uint32(32 - self.BITS)

    def words(self, data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their number in each word): words of size[i] > 0 UTF-8 bytes each, one after another in data."""
        at = np.cumsum(size) - size
        last = np.zeros(len(data), np.intp)
        last[at + size - 1] = 1
        data = self.first[last, data]
        count = np.zeros(len(size), np.int64)
        out = []
        for low, high in zip((0, 6, 8, 10, 13), (6, 8, 10, 13, 2 * WIDE)):
            which = np.flatnonzero((size > low) & (size <= high))
            if len(which):
                ids, count[which] = self._merged(data, at[which], size[which], high)
                out.append((which, ids))
        flat = np.empty(int(count.sum()), np.uint32)
        place = np.cumsum(count) - count
        for which, ids in out:
            flat[_spans(place[which], count[which])] = ids
        return flat, count

    def _merged(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """One row a word; a step merges one pair of each word that still has one."""
        column = np.arange(width + 1, dtype=np.uint8)
        real = column < size[:, None]
        ids = np.zeros(real.shape, np.uint16)
        ids[real] = data[_spans(at, size)]
        rank = np.full(real.shape, self.NONE, np.uint16)
        pair = np.zeros(real.shape, bool)
        pair[:, :-1] = real[:, 1:]
        rank[pair] = self.ranks(ids[pair], ids[:, 1:][pair[:, :-1]])
        done, count, rows, left = ids.copy(), size.copy(), np.arange(len(size)), size.copy()
        while len(rows):
            j = rank.argmin(1)
            least = rank[np.arange(len(rows)), j]
            more = least < self.NONE
            if not more.all():
                over = ~more
                done[rows[over]], count[rows[over]] = ids[over], left[over]
                ids, rank, rows, left, j, least = (x[more] for x in (ids, rank, rows, left, j, least))
                if not len(rows):
                    break
            keep = column <= j.astype(np.uint8)[:, None]
            # what is right of the pair moves up; the last column is never part of a word
            for x in (ids, rank):
                x[:, :-1] = np.where(keep[:, :-1], x[:, :-1], x[:, 1:])
            row = np.arange(len(rows))
            left = left - 1
            ids[row, j] = made = self.made[least]
            rank[row, j] = np.where(j + 1 < left, self.ranks(made, ids[row, np.minimum(j + 1, width)]), np.uint16(self.NONE))
            inner = np.flatnonzero(j > 0)
            rank[inner, j[inner] - 1] = self.ranks(ids[inner, j[inner] - 1], made[inner])
        return done[column < count[:, None]], count


class ChunkEncoder(dict):
    """pre-token -> its ids as little-endian uint32 bytes; at most `limit` are remembered.

    With `plain` (the default vocabulary's normaliser and pre-tokeniser), texts without _ODD
    characters are split into pre-tokens here, which go straight to the vocabulary's model. All
    others are taken chunk by chunk between blanks, and odd chunks, like all of other
    vocabularies, go through the whole tokenizer. many() does the same for many texts, with
    numpy for those without _ODD characters and without remembering their pre-tokens.
    """

    def __init__(self, path: str, limit: int = 300_000):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.plain = path.endswith(DEFAULT_TOKENIZER)
        self.chunks: dict[str, bytes] = {}
        self.limit = limit
        self.alphabet = _byte_alphabet()
        self.path, self.merges = path, None

    def __missing__(self, part: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        shown = part if part.isascii() else "".join(map(self.alphabet.__getitem__, part.encode("utf-8")))
        found = [x.id for x in self.tokenize(shown)]
        got = self[part] = struct.pack(f"<{len(found)}I", *found)
        return got

    def _chunk(self, chunk: str) -> bytes:
        if self.plain and not _ODD.search(chunk):
            return b"".join(map(self.__getitem__, _PRETOKEN.findall(chunk.lower())))
        got = self.chunks.get(chunk)
        if got is None:
            if len(self.chunks) >= self.limit // 4:
                self.chunks.clear()
            got = self.chunks[chunk] = np.asarray(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        return got

    def ids(self, text: str | None) -> bytes:
        """Ids of the whole text, four bytes each."""
        if not text:
            return b""
        if self.plain and not _ODD.search(text):
            return b"".join(map(self.__getitem__, _PRETOKEN.findall(text.lower())))
        return b"".join(map(self._chunk, text.replace("\n", " ").split(" ")))

    def many(self, texts: list[str | None]) -> list[bytes]:
        """ids() of each text."""
        if not self.plain:
            return [self.ids(t) for t in texts]
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts):
            for part in _stretches(text or ""):
                held.append((i, part))
                size += len(part)
                if size >= STEP:
                    self._held(held, out)
                    held, size = [], 0
        self._held(held, out)
        return [b"".join(x) for x in out]

    def _held(self, held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        data = _even(part for _, part in held)
        odd = [data is None and _ODD.search(part) is not None for _, part in held]
        if any(odd):
            data = _even(part for x, (_, part) in zip(odd, held) if not x)
        found = iter(self._even_ids(data, [len(part) for x, (_, part) in zip(odd, held) if not x]))
        for x, (i, part) in zip(odd, held):
            out[i].append(self.ids(part) if x else next(found))

    def _even_ids(self, data: bytes, sizes: list[int]) -> list[bytes]:
        """Ids of each of some texts of so many bytes, joined by line ends."""
        if self.merges is None:
            self.merges = Merges(self.path)
        low = data.translate(_LOWER)
        b = np.frombuffer(low, np.uint8)
        start, end = _pretokens(low)
        size = end - start
        # a pre-token of up to WIDE bytes is two numbers, as no byte is 0
        eights = np.ndarray(len(b) + 9, "<u8", low + bytes(WIDE), strides=(1,))
        mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        head = eights[start] & mask[np.minimum(size, 8)]
        tail = np.zeros(len(start), np.uint64)
        long = np.flatnonzero(size > 8)
        tail[long] = eights[start[long] + 8] & mask[np.minimum(size[long] - 8, 8)]
        # equal ones are neighbours in the order of a hash; where the hash is shared, they only count as more than one
        hashed = head ^ (tail * np.uint64(0x9E3779B97F4A7C15))
        wide = size > WIDE
        hashed[wide] = np.uint64(0xFFFFFFFFFFFFFFFF)
        order = np.argsort(hashed)
        h, t, w = head[order], tail[order], wide[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1]) | w[1:] | w[:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]
        # the distinct ones' ids: short ones are merged here, wide ones remembered as elsewhere
        short = np.flatnonzero(~wide[one])
        letters = b[_spans(start[one[short]], size[one[short]])]
        two = letters >= 0x80
        after = np.cumsum(1 + two)
        utf8 = np.repeat(letters, 1 + two)
        utf8[after[two] - 2] = 0xC0 | letters[two] >> 6
        utf8[after[two] - 1] = 0x80 | letters[two] & 0x3F
        before = np.concatenate([[0], after])
        upto = np.cumsum(size[one[short]])
        flat, n = self.merges.words(utf8, before[upto] - before[upto - size[one[short]]])
        count = np.zeros(len(one), np.int64)
        count[short] = n
        place = np.zeros(len(one), np.int64)
        place[short] = np.cumsum(n) - n
        extra, at = [], len(flat)
        for k in np.flatnonzero(wide[one]).tolist():
            got = self[low[start[one[k]] : end[one[k]]].decode("latin-1")]
            extra.append(got)
            place[k], count[k] = at, len(got) // 4
            at += len(got) // 4
        flat = np.concatenate([flat, np.frombuffer(b"".join(extra), "<u4")]).astype("<u4", copy=False)
        count = count[which]
        ids = flat[_spans(place[which], count)].tobytes()
        upto = np.concatenate([[0], np.cumsum(count)]) * 4
        last = upto[np.searchsorted(start, np.cumsum(np.array(sizes, np.int64) + 1))].tolist()
        return [ids[i:j] for i, j in zip([0, *last], last)]


def _even(parts: Iterable[str]) -> bytes | None:
    """The texts joined by line ends as Latin-1, if none has an _ODD character."""
    try:
        data = "\n".join(parts).encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if data.translate(None, _EVEN) or b"<|" in data else data


def _stretches(text: str) -> Iterable[str]:
    """A text in stretches of about STEP characters that end before blanks."""
    at = 0
    while len(text) - at > STEP and (end := text.find(" ", at + STEP)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of this file, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
