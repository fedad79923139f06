"""Whole-text tokenisation in which each different chunk of text is encoded once.

Texts are cut, as bytes, where no token can span the cut: before a space or line feed after another character, and
between an ASCII letter or digit and ASCII punctuation. A chunk is known by a 64-bit polynomial hash of its bytes (random
byte values, odd random base); its ids are kept in a flat table. New chunks are encoded together; the ids of all chunks are
then gathered by array operations. The table is emptied when it is full: it stays bounded, and results never depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

#: Fixed value: the public byte-level pre-tokenisation pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_LEVEL = regex.compile(BYTE_LEVEL)
#: Different chunks remembered by one Python worker, some 50 bytes each.
MEMORY = 1_500_000
#: Bytes of text that are worked on at a time, if a text isn't longer.
WINDOW = 2_000_000
#: Chunks given to the library in one string.
JOINED = 200

#: Powers of the base are made for 2^POWERS values at least, so that windows of all sizes share one table.
POWERS = 21

_rng = np.random.default_rng(20240611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**62)) * 4 + 5
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers modulo 2^64, and those of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base % 2**64, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [starts, ends) of an array of bytes."""
    n = 1 << max(POWERS, int(values.size).bit_length())
    power, inverse = _powers(n)
    sums = np.zeros(values.size + 1, np.uint64)
    np.cumsum(_BYTE[values] * power[: values.size], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def byte_level_pieces(chunk: str) -> list[str]:
    return _BYTE_LEVEL.findall(chunk)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of an Arrow array, and where each begins, with the end; a null counts as empty."""
    texts = pa.array([], pa.large_binary()) if len(texts) == 0 else texts.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    at = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


class TextEncoder:
    """encode: the ids of many strings; loose: case and leading white space of a chunk don't matter to its ids."""

    def __init__(self, encode: Callable[[list[str]], list[np.ndarray]], special: Iterable[str] = (), loose: bool = False) -> None:
        self.encode, self.special, self.loose = encode, [s.encode() for s in special], loose
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ends, self.ids, self.unsafe = np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, bool)

    def _chunks(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        space = _SPACE[data]
        cut = (data == 32) | (data == 10)
        cut[1:] &= ~space[:-1]
        cut[1:] |= _PUNCT[data[1:]] & _ALNUM[data[:-1]]
        cut[begin[begin < data.size]] = True
        return np.flatnonzero(cut)

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place in the table of each chunk; new chunks are encoded."""
        if self.loose:
            led = ((data[starts] == 32) | (data[starts] == 10)) & (ends - starts > 1)
            h = span_hashes(_LOWER[data], starts + led, ends)
        else:
            h = span_hashes(data, starts, ends)
        kinds, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, kinds), max(0, self.keys.size - 1))
        known = self.keys[at] == kinds if self.keys.size else np.zeros(kinds.size, bool)
        place = np.empty(kinds.size, np.int64)
        place[known] = self.places[at[known]]
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            got = self.encode(texts)
            size = np.fromiter(map(len, got), np.int64, len(got))
            place[new] = np.arange(new.size) + self.unsafe.size
            self.unsafe = np.concatenate([self.unsafe, np.fromiter((t[-1:].isspace() for t in texts), bool, len(texts))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
            self.ids = np.concatenate([self.ids, *got])
            keys = np.concatenate([self.keys, kinds[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.places = keys[order], np.concatenate([self.places, place[new]])[order]
        return place[back]

    def _window(self, data: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
        """The ids of each text of a window."""
        n = begin.size - 1
        starts = self._chunks(data, begin[:-1])
        ends = np.append(starts[1:], data.size)
        place = self._places(data, starts, ends) if starts.size else np.zeros(0, np.int64)
        lo = np.searchsorted(starts, begin)  # a text's first chunk
        size = self.ends[place + 1] - self.ends[place]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.ends[place] - total[:-1], size) + np.arange(total[-1])]
        # a chunk that ends in white space is safe only as its text's last
        odd = np.zeros(n, bool)
        bad = np.flatnonzero(self.unsafe[place])
        bad = bad[~np.isin(bad, lo[1:] - 1)]
        odd[np.searchsorted(lo, bad, side="right") - 1] = True
        raw = data.tobytes() if self.special or bad.size else b""
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                odd[np.searchsorted(begin, at, side="right") - 1] = True
                at = raw.find(s, at + 1)
        out = [ids[a:b] for a, b in zip(total[lo[:-1]].tolist(), total[lo[1:]].tolist())]
        for i in np.flatnonzero(odd).tolist():
            out[i] = self.encode([raw[begin[i] : begin[i + 1]].decode()], True)[0]
        if self.unsafe.size > MEMORY:
            self.clear()
        return out

    def encode_many(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Each text's ids as an array of unsigned 32-bit integers."""
        data, begin = text_bytes(texts)
        i, n = 0, begin.size - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + WINDOW, side="right")) - 1)
            yield from self._window(data[begin[i] : begin[j]], begin[i : j + 1] - begin[i])
            i = j


@lru_cache(maxsize=4)
def library_encoder(path: str, byte_level: bool) -> TextEncoder:
    """Encodes by the tokenizers library with the file at path, special tokens not added."""
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    added = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
    mark, mark_id = next(((s, i) for s, i in added.items()), (None, None))

    def encode(texts: list[str], whole: bool = False) -> list[np.ndarray]:
        if whole or mark is None:
            return [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[np.ndarray] = []
        for k in range(0, len(texts), JOINED):  # a special token between two chunks keeps them apart
            part = texts[k : k + JOINED]
            ids = np.array(tok.encode_batch_fast([mark.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = [-1, *np.flatnonzero(ids == mark_id).tolist(), ids.size]
            out += [ids[a + 1 : b] for a, b in zip(at[:-1], at[1:])]
        return out

    return TextEncoder(encode, added, loose=not byte_level)
