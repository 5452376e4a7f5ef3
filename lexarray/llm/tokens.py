"""Token counts of whole texts by a byte-level BPE tokenizer, without a shuffle of pre-tokens.

Two tiers. A first pass keeps, in each task, a table of 2**bits cells with the pre-token that holds the majority of each
cell; the cells of all tasks are merged, and the surviving pre-tokens' token counts go to all workers as one compact hash
table. In the second pass a pre-token that the table lacks is encoded by the library once, and a cache of the worker
process, which outlives the task, remembers its count. Which pre-tokens the table holds changes the time, not the result.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarray.llm import tables
from lexarray.llm.kernels import _POWERS, mix

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_MEMBERS = {_LETTER: "a", _NUMBER: "1", _OTHER: "!"}
_APOSTROPHE, _BLANK = 0x27, 0x20
#: Code points that are tokenised together.
_RUN = 1 << 20
#: Cells in one row of a merged table.
_CELLS = 512
_CELL = np.dtype([("key", np.uint64), ("weight", np.int64), ("tokens", np.uint16)])
#: Entries of a worker's cache, after which it starts anew.
_CACHE = 1 << 19
#: Longer pre-tokens go by BLAKE2: a polynomial modulo 2**64 is equal for some long regular ones, whatever its base.
_LONG = 256


def _loaded(definition: str):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(definition)
    out.no_truncation()
    out.no_padding()
    return out


@lru_cache(maxsize=4)
def _classes(definition: str) -> np.ndarray:
    """Letter, number, white space or other for every code point, as the tokenizer's own pre-tokenizer has them.

    Categories of this Python's Unicode tables are a first guess: points of a guessed class have to go into one pre-token
    together. Where a group of them does not, as versions of Unicode differ, each is tried after a member of each class.
    """
    split = _loaded(definition).pre_tokenizer.pre_tokenize_str
    out = np.full(0x110000, _SPACE, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    guess: dict[int, list[int]] = {_LETTER: [], _NUMBER: [], _OTHER: []}
    unsure = []
    for c in points:
        x = unicodedata.category(chr(c))[0]
        guess[_LETTER if x == "L" else _NUMBER if x == "N" else _OTHER].append(c)
    for kind, member in _MEMBERS.items():
        for some in (guess[kind][k : k + 256] for k in range(0, len(guess[kind]), 256)):
            if len(split(member + "".join(map(chr, some)))) == 1:
                out[some] = kind
            else:
                unsure += some
    for c in unsure:
        out[c] = next((kind for kind, member in _MEMBERS.items() if len(split(member + chr(c))) == 1), _SPACE)
    return out


def _starts(points: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in consecutive texts with code points `points` and first positions `at`.

    Runs of letters, of numbers and of other characters take one blank before them along; of white space before
    anything else the last character stands alone; endings such as 's after an apostrophe are pre-tokens.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes[points]
    first = np.zeros(n, bool)
    first[at[:-1][at[:-1] < n]] = True
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    turn = first.copy()
    turn[1:] |= kind[1:] != kind[:-1]
    start = turn.copy()
    space = kind == _SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = points[:-1] == _BLANK
    start[turn & ~space & after_blank & ~first] = False
    before_other = np.zeros(n, bool)
    before_other[:-1] = turn[1:] & ~last[:-1]
    start[space & before_other] = True
    # endings: an apostrophe that is a pre-token's first and only character, then s, t, m, d or re, ve, ll
    at_end = np.flatnonzero(start & (points == _APOSTROPHE) & before_other)
    at_end = at_end[kind[at_end + 1] == _LETTER]
    if len(at_end):
        one = points[at_end + 1]
        inside = at_end + 2 < n
        inside[inside] &= ~first[at_end[inside] + 2]
        two = np.where(inside, points[np.minimum(at_end + 2, n - 1)], 0)
        size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
        hit = size > 0
        start[at_end[hit] + 1] = False
        cut = at_end[hit] + 1 + size[hit]
        start[cut[cut < n]] = True
    return np.flatnonzero(start)


class Counter:
    """Counts tokens of texts; one lives in each worker process, as the value of a broadcast, with its cache."""

    def __init__(self, definition: str, classes: np.ndarray, keys: np.ndarray | None = None, tokens: np.ndarray | None = None) -> None:
        self.definition, self.classes, self.keys, self.tokens = definition, classes, keys, tokens
        names = _specials(definition)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        self.hint = os.path.commonprefix(names).encode()
        self.tokenizer, self.cache = None, {}

    def __getstate__(self) -> dict:
        return vars(self) | {"tokenizer": None, "cache": {}}

    def encoded(self, pieces: list[str]) -> list[int]:
        """Numbers of tokens of pre-tokens, by the library."""
        if self.tokenizer is None:
            self.tokenizer = _loaded(self.definition)
        return list(map(len, self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)))

    def runs(self, column: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of pieces of texts, each with its string, its pre-tokens' hashes and edges, and their texts' places in the column."""
        held, owners, size = [], [], 0
        for i, raw in enumerate(column.cast(pa.binary()).to_pylist()):
            for piece in self.pieces((raw or b"").decode("utf-8", "replace")):
                held.append(piece)
                owners.append(i)
                size += len(piece)
                if size >= _RUN:
                    yield self._run(held, owners)
                    held, owners, size = [], [], 0
        if held:
            yield self._run(held, owners)

    def pieces(self, text: str) -> Iterator[str]:
        """Parts of a text that can be tokenised apart: between special tokens, and where a long text has a blank after a
        visible ASCII character, before which no pre-token goes on."""
        for part in self.special.split(text) if self.special else (text,):
            a = 0
            while len(part) - a > _RUN:
                cut = _SAFE.search(part, a + _RUN)
                if cut is None:
                    break
                yield part[a : cut.start() + 1]
                a = cut.start() + 1
            if a < len(part):
                yield part[a:]

    def specials(self, column: pa.Array) -> np.ndarray:
        """How many special tokens each text holds."""
        out = np.zeros(len(column), np.int64)
        if self.special:
            for i, raw in enumerate(column.cast(pa.binary()).to_pylist()):
                if raw and self.hint in raw:
                    out[i] = len(self.special.findall(raw.decode("utf-8", "replace")))
        return out

    def _run(self, pieces: list[str], owners: list[int]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        text = "".join(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.concatenate([[0], np.cumsum(sizes)])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        start = _starts(points, at, self.classes)
        edge = np.append(start, len(points))
        _POWERS.to(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(points)], out=total[1:])
        keys = mix((total[edge[1:]] - total[start]) * _POWERS.down[start] + np.diff(edge).astype(np.uint64))
        for j in np.flatnonzero(np.diff(edge) > _LONG):
            keys[j] = int.from_bytes(blake2b(text[edge[j] : edge[j + 1]].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        owner = np.asarray(owners, np.int64)[np.searchsorted(at, start, side="right") - 1]
        return text, keys, edge, owner

    def counted(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        out = self.specials(column)
        for text, keys, edge, owner in self.runs(column):
            cell = (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)
            found = (self.keys[cell] == keys) & (self.tokens[cell] > 0)  # a cell whose tasks' majorities cancel out keeps a key without a count
            n = np.where(found, self.tokens[cell], 0).astype(np.int64)
            missing = np.flatnonzero(~found)
            if len(missing):
                names, where, inverse = np.unique(keys[missing], return_index=True, return_inverse=True)
                names, where = names.tolist(), missing[where]
                if len(self.cache) > _CACHE:
                    self.cache.clear()
                new = [k for k, name in enumerate(names) if name not in self.cache]
                self.cache.update(zip([names[k] for k in new], self.encoded([text[edge[j] : edge[j + 1]] for j in where[new]]), strict=True))
                n[missing] = np.array([self.cache[name] for name in names], np.int64)[inverse]
            out += np.bincount(owner, n, len(column)).astype(np.int64)
        return out


#: A blank after a visible ASCII character, the character first.
_SAFE = re.compile("[!-~](?= )")


def _specials(definition: str) -> list[str]:
    """The special tokens' strings, longer ones first."""
    return sorted((x["content"] for x in json.loads(definition)["added_tokens"]), key=len, reverse=True)


def _checked(definition: str) -> str:
    """The definition, if it is of a byte-level BPE tokenizer whose pre-tokens are those of _starts()."""
    x = json.loads(definition)
    pre = x["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not x["normalizer"]
    if not plain or x["model"].get("type", "BPE") != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in x["added_tokens"]):
        raise ValueError("only byte-level BPE tokenizers without a normalizer are supported")
    return definition


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cell by cell the majority of two tables: equal keys add up, of different ones the heavier stays by the difference."""
    same = a["key"] == b["key"]
    out = np.where(a["weight"] >= b["weight"], a, b)
    out["weight"] = np.where(same, a["weight"] + b["weight"], np.abs(a["weight"] - b["weight"]))
    return out


def _sketch(batches: Iterator[pa.RecordBatch], counter: Counter, cells: int) -> np.ndarray:
    """A task's majority pre-token of every cell with its number of tokens."""
    held, names = np.zeros(cells, _CELL), np.full(cells, None, object)
    for batch in batches:
        for text, keys, edge, _ in counter.runs(batch.column(0)):
            found, where, times = np.unique(keys, return_index=True, return_counts=True)
            cell = (found & np.uint64(cells - 1)).astype(np.int64)
            order = np.lexsort((times, cell))
            top = order[np.append(cell[order][1:] != cell[order][:-1], True)] if len(order) else order
            others = np.bincount(cell, times, cells).astype(np.int64)
            new = np.zeros(cells, _CELL)
            new["key"][cell[top]] = found[top]
            new["weight"][cell[top]] = np.maximum(0, 2 * times[top] - others[cell[top]])
            merged = _merged(held, new)
            changed = np.flatnonzero((merged["key"] != held["key"]) & (merged["weight"] > 0))
            place = np.zeros(cells, np.int64)
            place[cell[top]] = where[top]
            for c in changed:
                names[c] = text[edge[place[c]] : edge[place[c] + 1]]
            held = merged
    kept = np.flatnonzero((held["weight"] > 1) & (names != None))  # noqa: E711  elementwise
    sizes = np.array(counter.encoded(names[kept].tolist()) if len(kept) else [], np.int64)
    short = sizes <= np.iinfo(np.uint16).max  # a longer one is left to the second tier
    out = np.zeros(cells, _CELL)
    out[kept[short]] = held[kept[short]]
    out["tokens"][kept[short]] = sizes[short]
    return out


_BLOCKS = "block int, cells binary"


def _packed(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [(b, zlib.compress(x.tobytes(), 1)) for b, x in blocks.items() if x["weight"].any()]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["block", "cells"])


def frequent(texts: DataFrame, counter: Broadcast, bits: int) -> np.ndarray:
    """The merged cells of all tasks: 2**bits of them, however large the table is."""
    cells = 1 << bits
    wide = min(_CELLS, cells)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _sketch(batches, counter.value, cells)
        yield _packed({b: own[b * wide : (b + 1) * wide] for b in range(cells // wide)})

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(zlib.decompress(x.as_py()), _CELL)
                held[b] = _merged(held[b], x) if b in held else x
        yield _packed(held)

    out = np.zeros(cells, _CELL)
    for r in texts.mapInArrow(find, _BLOCKS).repartition(cells // wide, "block").mapInArrow(join, _BLOCKS).collect():  # at most one row a block
        out[r["block"] * wide : (r["block"] + 1) * wide] = np.frombuffer(zlib.decompress(bytes(r["cells"])), _CELL)
    return out


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, bits: int = 15) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row of docs; tokenizer is the path of a byte-level BPE definition, read
    on the driver and sent to the workers (a file of a megabyte or two, which does not grow with the data).

    Tokens are those of the library without begin, end or added special tokens, truncation or padding; strings of special
    tokens inside a text are one token each. Pre-tokens go by 64-bit hashes. Cases: null and empty texts have no bytes and
    no tokens; invalid UTF-8 counts as replacement characters; a long text is split at blanks, which changes no token, so
    its memory is bounded unless a text has no blank; null and repeated ids and repeated rows give a row each; an empty
    table gives no rows; other columns of docs, whatever their names, are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        definition = _checked(f.read())
    classes = _classes(definition)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    plain = tables.sent(spark, Counter(definition, classes))
    top = frequent(rows.select("text"), plain, bits)
    plain.destroy()
    counter = tables.sent(spark, Counter(definition, classes, top["key"].copy(), np.where(top["weight"] > 0, top["tokens"], 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counter.value.counted(batch.column(1)))], ["id", "n_bytes", "n_tokens"])

    kind = rows.schema["id"].dataType.simpleString()
    sized = rows.select("id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = sized.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
