"""Texts as flat UTF-8 bytes: hashes of spans, words, and shingles, a batch at a time, in numpy.

All hashes are fixed functions of the bytes, so they agree on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer text is worked on alone, whole.
STEP_BYTES = 1_000_000
_ODD, _P, _GOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (shifts and odd multipliers)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(seed: int) -> np.uint64:
    return mix(np.array([(seed * _GOLD + 1) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, p in enumerate((_P, inverse)):
            t = np.full(max(n, STEP_BYTES + 1), p, np.uint64)
            t[0] = 1
            _powers[k] = np.multiply.accumulate(t)
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most so many bytes together, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies."""
    up, down = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_letters()[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64) * _ODD)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first): the spans of words, runs of bytes other than space and \\x09-\\x0D, and each text's first word's place."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    begin, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return begin, end, np.searchsorted(begin, offsets)


def shingles(word_hash: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every window of ``size`` words; a text with fewer words, but some, has one window of all."""
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n) + first[text]
    out = np.zeros(len(text), np.uint64)
    stop = first[text + 1] if len(text) else at
    for k in range(size):
        inside = at + k < stop
        out = out * _P + np.where(inside, word_hash[np.minimum(at + k, len(word_hash) - 1)], np.uint64(k + 1)) if len(text) else out
    return mix(out), text


def distinct(value: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of each text, by text then value, and how often each occurs there."""
    if not len(value):
        return value, text, np.empty(0, np.int64)
    order = np.lexsort((value, text))
    v, t = value[order], text[order]
    new = np.empty(len(v), bool)
    new[0] = True
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    place = np.flatnonzero(new)
    return v[place], t[place], np.diff(np.append(place, len(v)))
