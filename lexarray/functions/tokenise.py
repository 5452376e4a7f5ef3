"""The search tokeniser over Arrow batches: each different word of a task is split once, then looked up."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexarray.functions import text

#: Words a task remembers, after which it starts anew.
_MEMORY = 1 << 16
#: Bytes of texts that are split together.
_RUN = 1 << 20
#: Of bytes, those that are delimiters; all are ASCII.
_DELIMITER = np.array([x < 128 and bool(re.fullmatch(text.DELIMITERS, chr(x), re.ASCII)) for x in range(256)])
_LETTER = np.array([chr(x).isascii() and chr(x).isalpha() for x in range(256)])


class Tokeniser:
    """text.tokens() of texts without comments, and text.raw_tokens() with raw."""

    def __init__(self, language: str | None = None, raw: bool = False) -> None:
        self.delimiters = re.compile(text.DELIMITERS, re.ASCII)
        self.camel = re.compile(text.CAMEL)
        self.stop = {*text.STOP_WORDS, *text.LANGUAGE_WORDS.get(language or "", ())}
        self.raw, self.known = raw, {}

    def parts(self, word: str) -> list[str]:
        names = [word, *([p for p in re.split("[_-]", word) if p] if "_" in word or "-" in word else [])]
        camel = self.camel.findall(word)
        found = [x.lower() for x in names + (camel if len(camel) > 1 else [])]
        return found if self.raw else [t for t in found if self.kept(t)]

    def kept(self, term: str) -> bool:
        if term.isalpha():
            return len(term) > 2 and term not in self.stop
        kinds = [unicodedata.category(c) for c in term]
        return len(term) > 2 and term not in self.stop and all(k[0] in "LN" for k in kinds) and any(k != "Nd" for k in kinds)

    def __call__(self, content: str | None) -> list[str]:
        out: list[str] = []
        known, stop, raw = self.known, self.stop, self.raw
        for word in self.delimiters.split(content or ""):
            if len(word) > 1:
                if word.isascii() and word.isalpha() and (word.islower() or word[1:].islower()):  # one part, all letters: nothing to split or remember
                    low = word.lower()
                    if raw or len(low) > 2 and low not in stop:
                        out.append(low)
                    continue
                out += known.get(word) or self.of(word)
        return out

    def of(self, word: str) -> list[str]:
        """The tokens of one word, remembered."""
        if len(word) < 2:
            return []
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= _MEMORY:
                self.known.clear()
            found = self.known[word] = self.parts(word)
        return found


def _runs(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in runs of about _RUN bytes, so that what Python holds does not grow with an Arrow batch."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())).to_numpy()
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _RUN, side="right")))
        yield texts.slice(a, b - a)
        a = b


def sliced(texts: pa.Array) -> Iterator[list[str]]:
    return (run.to_pylist() for run in _runs(texts))


def _tokens(texts: pa.Array, language: str | None, raw: bool) -> pa.Array:
    split, kind = Tokeniser(language, raw), pa.list_(pa.string())
    return pa.concat_arrays([pa.array([], kind), *(pa.array([split(x) for x in some], kind) for some in sliced(texts))])


def _taken(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings from first to end of a text's bytes."""
    bounds = np.append(np.stack([first, end], 1).reshape(-1), len(data)).astype(np.int32)
    every = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(data))
    return every.take(pa.array(np.arange(0, 2 * len(first), 2)))


def _occurrences(texts: pa.Array, split: Tokeniser) -> tuple[np.ndarray, pa.Array]:
    """The tokens of a run of texts, in no order, and which text each is of. Plain words, a letter with small ones after it, are
    looked at as bytes; each different one of the rest is split once."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].copy()
    at = at - at[0]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_DELIMITER[data]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]  # a word ends with its text
    begins[edges] = inside[edges + 1]
    stops[edges - 1] = inside[edges]
    first, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    owner = np.searchsorted(at, first, side="right") - 1
    odd = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data < 97) | (data > 122), out=odd[1:])
    plain = (odd[end] == odd[first + 1]) & _LETTER[data[first]] & (end - first > 1)
    other = _taken(data, first[~plain], end[~plain]).dictionary_encode()
    found = pa.array([split.of(x) for x in other.dictionary.to_pylist()], pa.list_(pa.string())).take(other.indices)
    owners = np.repeat(owner[~plain], pc.list_value_length(found).to_numpy(zero_copy_only=False))
    plain &= end - first > 2
    data[first[plain]] |= 32
    words = _taken(data, first[plain], end[plain])
    kept = pc.invert(pc.is_in(words, value_set=pa.array(sorted(split.stop), pa.string())))
    return np.append(owner[plain][kept.to_numpy(zero_copy_only=False)], owners), pa.concat_arrays([words.filter(kept), found.flatten()])


def _counts(texts: pa.Array, language: str | None) -> pa.Array:
    split = Tokeniser(language)
    parts = [pa.array([], pa.struct([("dl", pa.int32()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))]))]
    for some in _runs(texts):
        owner, terms = _occurrences(some, split)
        terms = terms.dictionary_encode()
        size = max(1, len(terms.dictionary))
        key = np.sort(owner * size + terms.indices.to_numpy().astype(np.int64))
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        tf, key = np.diff(np.append(at, len(key))).astype(np.int32), key[at]
        starts = pa.array(np.searchsorted(key, np.arange(len(some) + 1) * size), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, x) for x in (terms.dictionary.take(pa.array(key % size)), pa.array(tf))]
        parts.append(pa.StructArray.from_arrays([pa.array(np.bincount(owner, minlength=len(some)).astype(np.int32)), *lists], ["dl", "terms", "tfs"]))
    return pa.concat_arrays(parts)


def tokens(content: Column, language: str | None = None, raw: bool = False) -> Column:
    """text.tokens() or text.raw_tokens() of a text column, by Arrow batches."""

    @F.arrow_udf("array<string>")
    def run(texts: pa.Array) -> pa.Array:
        return _tokens(texts, language, raw)

    return run(text.strip_comments(F.coalesce(content, F.lit("")), language))


def counted(content: Column, language: str | None = None) -> Column:
    """struct(dl, terms, tfs): how many tokens a text has, its different ones and how often each occurs."""

    @F.arrow_udf("struct<dl:int,terms:array<string>,tfs:array<int>>")
    def run(texts: pa.Array) -> pa.Array:
        return _counts(texts, language)

    return run(text.strip_comments(F.coalesce(content, F.lit("")), language))
