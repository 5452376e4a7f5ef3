"""Vectorised text kernels for Arrow batches.

All of them work on the UTF-8 bytes of whole texts. The word classes in use only separate at ASCII
characters, so a split of the bytes is a split of the code points. Hashes are 64 bits wide and the
same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes belong to words, given the ranges (both ends included) that do not."""
    table = np.ones(256, dtype=bool)
    for a, b in excluded:
        table[a : b + 1] = False
    return table


#: Words of letters and digits, after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM_WORDS = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Words between white space: [^\x20\x09-\x0D]+
SPACED_WORDS = byte_class([(0x20, 0x20), (0x09, 0x0D)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse, grown to the longest text seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, _CHUNK + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(n, base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))


_POWERS = _Powers()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


class Words:
    """The words of some consecutive texts.

    start, end: byte offsets in data; hash: uint64 of each word; first: index of each text's first
    word, with one entry more for the end.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, words: np.ndarray) -> None:
        inside = words[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = at[:-1][at[:-1] < len(data)]
        before[starts] = False
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = at[1:][at[1:] > 0] - 1
        after[ends] = False
        self.data = data
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        _POWERS.to(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _POWERS.down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, at)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each position on, and which positions have n words in their text."""
        h, size = self.hash, len(self.hash)
        out = np.zeros(size, dtype=np.uint64)
        for k in range(min(n, size)):
            out[: size - k] += h[k:] * _POWER_OF[k]
        last = np.repeat(self.first[1:], np.diff(self.first))
        return mix(out + np.uint64(n)), np.arange(size) + n <= last


#: Weights of a gram's words; odd, so that no word's bits are lost.
_POWER_OF = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(64)]


def gram_of(hashes: np.ndarray) -> np.uint64:
    """The same hash as Words.grams gives, of one sequence of word hashes."""
    with np.errstate(over="ignore"):
        total = np.uint64(0)
        for k, h in enumerate(hashes):
            total = total + h * _POWER_OF[k]
        return mix(np.array([total + np.uint64(len(hashes))], dtype=np.uint64))[0]


def chunks(column: pa.Array, lower: np.ndarray = SAME, size: int = _CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about a megabyte together: first and last index, bytes, offsets from 0. A longer text is a run of its own."""
    data, at = utf8(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, side="right")) - 1)
        part = data[at[i] : at[j]]
        yield i, j, (part if lower is SAME else lower[part]), at[i : j + 1] - at[i]
        i = j


def shingles(words: Words, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles, sorted; of fewer words, all as one; without words, none."""
    grams, _ = words.grams(n)
    first = words.first
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield np.array([gram_of(words.hash[a:b])], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)
