"""Sets of word shingles of whole texts, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .chunks import mix, span_hashes, text_bytes

#: Words of a shingle.
WORDS = 5
#: Bytes of texts that are worked on at a time, if a text isn't longer.
WINDOW = 2_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x2545F4914F6CDD1D)


def _window(data: np.ndarray, begin: np.ndarray) -> Iterator[np.ndarray]:
    n = begin.size - 1
    data = _LOWER[data]
    inside = ~_SPACE[data]
    edge = np.zeros(data.size + 1, bool)
    edge[begin] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:-1])) if data.size else np.zeros(0, np.int64)
    stops = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1 if data.size else starts
    h = span_hashes(data, starts, stops)
    first = np.searchsorted(starts, begin)
    run = h.copy()
    for k in range(1, WORDS):
        run[: h.size - k] = run[: h.size - k] * _STEP + h[k:]
    run = mix(run)
    for i in range(n):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= WORDS:
            held = np.sort(run[a : b - WORDS + 1])
            yield held[np.concatenate([[True], held[1:] != held[:-1]])]
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = whole * _STEP + x
            yield mix(np.array([whole]))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The set of each text: distinct shingles of WORDS words, A-Z lower-cased; with fewer words the whole sequence as one;
    without any, empty. A null is an empty text."""
    data, begin = text_bytes(texts)
    i, n = 0, begin.size - 1
    with np.errstate(over="ignore"):
        while i < n:
            j = max(i + 1, int(np.searchsorted(begin, begin[i] + WINDOW, side="right")) - 1)
            yield from _window(data[begin[i] : begin[j]], begin[i : j + 1] - begin[i])
            i = j
