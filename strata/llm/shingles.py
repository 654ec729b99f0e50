"""Word shingles of a batch of texts as 64-bit hashes, by array operations over the bytes of the whole batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from strata.llm.common import mix

WORDS = 5
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF97  # of the powers by which a byte's place counts; odd, so that they have inverses
_LOW = 12  # bits of a place that one table of powers covers


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = (_powers(b, 1 << _LOW) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _bytes(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, end to end, and where each begins and the last one ends."""
    if isinstance(texts, list):
        datas = [t.encode("utf-8", "replace") for t in texts]
        return np.frombuffer(b"".join(datas), np.uint8), np.cumsum([0, *map(len, datas)])
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    edges = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data or b"", np.uint8)[edges[0] : edges[-1]], edges - edges[0]


def word_hashes(texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of each text in order, and the number of words of each text.

    A word's hash is the sum of its bytes' random numbers times the powers of their places. Sums run over the whole batch;
    a difference of two, times the inverse power of the place where the word begins, is the word's own.
    """
    flat, edges = _bytes(texts)
    size = len(flat)
    word = ~_SPACE[flat]
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = edges[:-1][edges[:-1] < size]  # a text begins a word and ends the one before
    opens, closes = np.ones(size, bool), np.ones(size, bool)
    opens[1:] = ~word[:-1]
    closes[:-1] = ~word[1:]
    opens[starts] = True
    closes[starts[starts > 0] - 1] = True
    begin, last = np.flatnonzero(word & opens), np.flatnonzero(word & closes)
    rows = (size >> _LOW) + 1
    up, down = (_powers(pow(b, 1 << _LOW, 1 << 64), rows) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    value = _BYTE[flat]
    value *= (up[:, None] * _UP).reshape(-1)[:size]
    ends = np.cumsum(value)
    h = (ends[last] - ends[begin] + value[begin]) * down[begin >> _LOW] * _DOWN[begin & ((1 << _LOW) - 1)]
    return mix(h + (last - begin + 1).astype(np.uint64)), np.diff(np.searchsorted(begin, edges))


def sort_each(key: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The keys of each text sorted, in place."""
    ends = np.cumsum(sizes)
    for s, e in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
        if e - s > 1:
            key[s:e].sort()
    return key


def shingle_sets(texts: list[str] | pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of every distinct shingle, sorted by both, and the size of each text's set.

    A text with fewer words has one shingle, the whole sequence; a text without words has none.
    """
    h, counts = word_hashes(texts)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    key = np.zeros(n, np.uint64)
    begin = np.cumsum(counts) - counts
    left = np.repeat(begin + counts, counts) - np.arange(n)  # words from here to the end of the text
    for k in range(words):
        key *= _STEP
        m = max(n - k, 0)
        key[:m] += np.where(left[:m] > k, h[k:], np.uint64(0x51ED270B))
        key[m:] += np.uint64(0x51ED270B)
    whole = (counts < words) & (counts > 0)
    keep = left >= words
    keep[begin[whole]] = True
    sizes = np.where(whole, 1, np.maximum(counts - words + 1, 0))
    key = sort_each(mix(key[keep]), sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[new], owner[new]
    return owner, key, np.bincount(owner, minlength=len(texts))
