"""Words of many texts at once, as flat arrays over UTF-8 bytes.

A word is a longest run of characters other than ASCII white space (space, \\t to \\r).
White space is one byte each and never part of another character, so bytes suffice.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .shared import mix

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15 | 1
#: Its inverse modulo 2**64.
_INVERSE = pow(_ODD, -1, 1 << 64)


@functools.lru_cache(16)
def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def powers(n: int, base: int = _ODD) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. Long ones aren't kept, as Python workers live on."""
    size = 1 << max(10, int(n).bit_length())
    return (_powers if size <= 1 << 16 else _powers.__wrapped__)(size, base)[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (nulls are empty)."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    at = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0, at_once: int = (1 << 16) - 1) -> np.ndarray:
    """64-bit hashes of byte ranges that are in order and don't overlap; an empty range has the hash of nothing.

    Running sums of byte * base**place give a range's sum times base**start, which its inverse takes away. Ranges are
    hashed about `at_once` bytes at a time, so that the powers are kept; a longer range comes alone.
    """
    size = end - start
    out = np.zeros(len(start), np.uint64)
    some = np.flatnonzero(size > 0)
    first, last = start[some], end[some]
    i = 0
    while i < len(some):
        j = max(i + 1, int(np.searchsorted(last, first[i] + at_once, "right")))
        at, n = first[i], int(last[j - 1] - first[i])
        sums = np.zeros(n + 1, np.uint64)
        np.add(buf[at : at + n], 1, out=sums[1:], dtype=np.uint64)
        sums[1:] *= powers(n)
        np.cumsum(sums, out=sums)
        s, e = first[i:j] - at, last[i:j] - at
        out[some[i:j]] = (sums[e] - sums[s]) * powers(n, _INVERSE)[s]
        i = j
    return mix(out + np.uint64(seed) + mix(size.astype(np.uint64)))


class Words:
    """start, end: byte range of each word; doc: its text; first: each text's first word, and the number of words."""

    def __init__(self, texts: pa.Array, table: np.ndarray | None = None):
        """table: what each byte stands for, if not for itself."""
        self.buf, self.at = utf8(texts)
        if table is not None:
            self.buf = table[self.buf]
        n = len(self.buf)
        solid = (self.buf > 32) | ((self.buf < 32) & ((self.buf < 9) | (self.buf > 13)))  # not SPACE, without a look-up for each byte
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        before = np.concatenate(([False], solid[:-1])) if n else solid
        after = np.concatenate((solid[1:], [False])) if n else solid
        self.start = np.flatnonzero(solid & (~before | edge[:-1]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.at, "left")
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return hashes(self.buf, self.start, self.end)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of k words within one text, and the windows' hashes."""
        n = len(self.hash)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        where = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        if k <= 8:
            h = np.zeros(n - k + 1, np.uint64)
            for j, p in enumerate(powers(k).tolist()):
                h += self.hash[j : n - k + 1 + j] * np.uint64(p)
        else:
            up = powers(n, 0xD1342543DE82EF95)
            down = powers(n, pow(0xD1342543DE82EF95, -1, 1 << 64))
            s = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * up, dtype=np.uint64)))
            h = (s[k:] - s[:-k]) * down[: n - k + 1]
        return where, mix(h[where] + np.uint64(k))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Text and hash of each shingle of k words; a text of 1 to k-1 words is one shingle."""
        where, h = self.windows(k)
        doc = self.doc[where]
        short = np.flatnonzero((self.count > 0) & (self.count < k))
        if len(short):
            lone = mix(np.array([hash_of(self.hash[self.first[i] : self.first[i + 1]]) for i in short], np.uint64))
            doc, h = np.concatenate((doc, short)), np.concatenate((h, lone))
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
        return doc, h


def hash_of(parts: np.ndarray) -> int:
    return int((parts * powers(len(parts), 0xA24BAED4963EE407)).sum(dtype=np.uint64)) ^ len(parts)
