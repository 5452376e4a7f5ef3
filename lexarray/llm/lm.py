"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs are quantised on a log scale. A count of level q is kept as q entries (n-gram, 1) ... (n-gram, q)
of one Bloom filter; a count is read back by probing for one level after another until one is missing. The filter is
sized for the entries counted and a rate of false hits. It lies in parts, each of which holds all the pairs of its
contexts (of very frequent contexts, some of the pairs), and is never put together: tokens are counted, and later read,
where the part of their pair is. They travel packed, gathered over many texts: a context once, a pair in five bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarray.llm import tables
from lexarray.llm.groups import turned
from lexarray.llm.kernels import LOWER, SPACED_WORDS, Words, chunks, mix, signed

#: Stand for the end and the start of a text; no word has a reserved hash but by chance of 2**-64.
_END, _START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A757A757A757A7)
_RUN = 1 << 20
#: Bits of a block of the filter, as a power of two.
_BLOCK = 10
#: Tokens that a task gathers before it sends them, and training tokens of a part of the filter.
_GATHER, _PART = 1 << 20, 1 << 22
#: Parts are told by so many bits; a context with more than one of 2**_HOT tokens is dealt by its pairs.
_ROUTE, _HOT = 12, 18
#: Bits of a pair's hash that travel beside its context.
_SHORT = 40
#: The parts are read in so many turns, each over all texts, so that what one turn shuffles is deleted before the next.
_TURNS = 2
#: In place of a word's level: its count is not at hand and has to be joined.
_OPEN = 255


#: What a key is moved by for each level.
_STEP = [np.uint64(k * 0xD1342543DE82EF95 % (1 << 64)) for k in range(65)]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0xA24BAED4963EE407) + mix(b + np.uint64(0x9FB21C651E98DF25)))


def levels(c: np.ndarray) -> np.ndarray:
    """1 for a count of 1, then one more for each doubling."""
    return 1 + np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)


def value(q: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the least of its counts, so that what is kept of a context's pairs is never
    more than the context's count."""
    return np.where(q < 1, 0.0, 2.0 ** (q - 1.0))


def _value(c: Column) -> Column:
    """The same of a column of counts."""
    return F.when(c > 0, F.pow(F.lit(2.0), F.length(F.bin(c)) - 1)).otherwise(0.0)


class Frequencies:
    """The part of a log-frequency filter that holds the keys with some first `skip` bits: 2**bits bits in blocks, all that
    is kept of a key lying in one of them. Where a key lies and is probed does not depend on skip, if bits + skip is the same."""

    def __init__(self, bits: int, skip: int = 0, words: np.ndarray | None = None, probes: int = 3) -> None:
        self.bits, self.skip, self.probes, self.inner = bits, skip, probes, min(bits, _BLOCK)
        self.words = np.zeros(max(1, (1 << bits) // 64), np.uint64) if words is None else words

    def _places(self, keys: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word and bit of each probe."""
        block = (keys << np.uint64(self.skip)) >> np.uint64(64 - (self.bits - _BLOCK)) if self.bits > _BLOCK else np.zeros(len(keys), np.uint64)
        h = mix(keys + _STEP[level])
        mask, start = np.uint64((1 << self.inner) - 1), block.astype(np.int64) << max(0, self.inner - 6)
        for k in range(self.probes):
            at = (h >> np.uint64(20 * k)) & mask
            yield start + (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        q = levels(counts)
        for level in range(1, int(q.max(initial=0)) + 1):
            for word, bit in self._places(keys[q >= level], level):
                np.bitwise_or.at(self.words, word, bit)

    def read(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, 0 where the first level is missing."""
        q, left, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
        while len(left) and level < 64:
            held = np.ones(len(left), bool)
            for word, bit in self._places(keys[left], level):
                held &= self.words[word] & bit != 0
            left = left[held]
            q[left] = level
            level += 1
        return value(q)


def needed_bits(entries: int, false_rate: float, probes: int = 3) -> int:
    """The power of two of a filter's bits for which at most false_rate of the probed keys that it lacks seem held; some
    more for blocks that hold more entries than others."""
    return max(20, int(np.ceil(np.log2(max(1, entries) * 1.02 * probes / -np.log1p(-(false_rate ** (1 / probes)))))))


class _Tally:
    """Counts of keys of one task, merged whenever many have gathered."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.held.append(keys)
        self.size += len(keys)
        if self.size > 1 << 20:
            self.fold()

    def fold(self) -> None:
        if self.held:
            keys = np.concatenate([self.keys, *self.held])
            counts = np.concatenate([self.counts, np.ones(self.size, np.int64)])
            self.keys, place = np.unique(keys, return_inverse=True)
            self.counts = np.bincount(place, counts, minlength=len(self.keys)).astype(np.int64)
            self.held, self.size = [], 0

    def batches(self, most: int = 0) -> Iterator[pa.RecordBatch]:
        """What has gathered, in pieces, if it is more than `most` keys: counts are summed again after the shuffle."""
        if len(self.keys) + self.size <= most:
            return
        self.fold()
        for i in range(0, len(self.keys), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(signed(self.keys[part])), pa.array(self.counts[part])], ["h", "c"])
        self.__init__()


def _texts(column: pa.Array) -> Iterator[tuple[int, Words, np.ndarray]]:
    """Runs of texts: first index, words, and of which text each word is."""
    for i, _, data, at in chunks(column, LOWER, _RUN):
        w = Words(data, at, SPACED_WORDS)
        yield i, w, np.repeat(np.arange(len(at) - 1), np.diff(w.first))


def _before(w: Words) -> np.ndarray:
    """The word before each word, the start at a text's first."""
    prev = np.empty_like(w.hash)
    prev[1:] = w.hash[:-1]
    prev[w.first[:-1][np.diff(w.first) > 0]] = _START
    return prev


def _last(w: Words) -> np.ndarray:
    """Each text's last word, the start where it has none."""
    return np.where(np.diff(w.first) > 0, w.hash[np.maximum(w.first[1:] - 1, 0)] if len(w.hash) else _START, _START)


def _within(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys are in sorted_keys, and whether."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows, whose last column is the text, with about _GATHER tokens: the other columns, and of each token the
    word before, the word, and the number of its row in the run. A text's end is a token."""
    rows, found, n, size = [], [], 0, 0
    for batch in batches:
        last = batch.num_columns - 1
        for i, w, of in _texts(batch.column(last)):
            m = len(w.first) - 1
            rows.append(batch.select(range(last)).slice(i, m))
            found += [(_before(w), w.hash, (n + of).astype(np.int32)), (_last(w), np.full(m, _END), np.arange(n, n + m, dtype=np.int32))]
            n, size = n + m, size + len(w.hash) + m
            if size >= _GATHER:
                out = (rows, *(np.concatenate(x) for x in zip(*found)))
                rows, found, n, size = [], [], 0, 0
                yield out
    if n:
        yield rows, *(np.concatenate(x) for x in zip(*found))


def _keys(contexts: np.ndarray, pairs: np.ndarray, of: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The filter's keys of pairs, given by the short hash and the number of the context. The first _ROUTE bits are the
    context's own, but for hot ones."""
    route = (mix(contexts) >> np.uint64(64 - _ROUTE))[of]
    route = np.where(_within(hot, contexts)[1][of], pairs >> np.uint64(_SHORT - _ROUTE), route)
    return (route << np.uint64(64 - _ROUTE)) | (mix(pairs) >> np.uint64(_ROUTE))


def _distinct(of: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs by context's number and short hash: these, the order that brings equal ones together, where each begins."""
    own = (of.astype(np.uint64) << np.uint64(_SHORT)) | pairs
    order = np.argsort(own)
    own = own[order]
    first = np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    at = np.flatnonzero(first)
    return (own[at] >> np.uint64(_SHORT)).astype(np.int64), own[at] & np.uint64((1 << _SHORT) - 1), order, at


def _dealt(prev: np.ndarray, word: np.ndarray, hot: np.ndarray, skip: int) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """For each of 2**skip parts that has some of the tokens: its number; contexts, the number of pairs of each, the pairs
    and how often each comes; of each pair one token; and the tokens in this order."""
    contexts, of = np.unique(prev, return_inverse=True)
    of, pairs, order, at = _distinct(of, _pair(prev, word) >> np.uint64(64 - _SHORT))
    times = np.diff(np.append(at, len(order)))
    part = (_keys(contexts, pairs, of, hot) >> np.uint64(64 - _ROUTE) >> np.uint64(_ROUTE - skip)).astype(np.uint16)
    turn = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[turn], np.arange((1 << skip) + 1))
    for p in np.flatnonzero(np.diff(ends)):
        own = turn[ends[p] : ends[p + 1]]
        first = np.flatnonzero(np.diff(of[own], prepend=-1))
        n = times[own]
        tokens = order[np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        columns = {"v": contexts[of[own[first]]], "n": np.diff(np.append(first, len(own))).astype(np.uint32), "low": pairs[own].astype(np.uint32), "high": (pairs[own] >> np.uint64(32)).astype(np.uint8), "c": n.astype(np.uint32)}
        yield int(p), columns, order[at[own]], tokens


_PACKED = "part int, v binary, n binary, low binary, high binary, c binary"
_KINDS = {"v": np.uint64, "n": np.uint32, "low": np.uint32, "high": np.uint8, "c": np.uint32}


def _packed(rows: list[tuple[int, dict[str, np.ndarray]]]) -> dict[str, pa.Array]:
    return {"part": pa.array([p for p, _ in rows], pa.int32())} | {name: pa.array([x[name].tobytes() for _, x in rows], pa.binary()) for name in (rows[0][1] if rows else ())}


def _column(table: pa.Table, name: str, kind: type, rows: slice = slice(None)) -> np.ndarray:
    """What the rows of a packed column hold, together."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in table.column(name)[rows])])


def _unpacked(table: pa.Table, rows: slice = slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, each pair's number of context, pairs and how often each comes."""
    v, n, low, high, c = (_column(table, name, kind, rows) for name, kind in _KINDS.items())
    return v, np.repeat(np.arange(len(v)), n), low | (high.astype(np.uint64) << np.uint64(32)), c.astype(np.int64)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held_fold: int = 0, bits: int | None = None, head: int = 1 << 20, weight: float = 0.6, false_rate: float = 0.01, most_bits: int = 29) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    Tokens are words between ASCII white space, lower-cased in A-Z, then one end. Rows whose crc32(doc_id as
    text) mod folds is not held_fold are learned from. base_score is exact: log10((c + 0.1) / (N + 0.1 (V + 1)))
    summed over tokens. score: log10 of weight * f(v, w) / d(v) + (1 - weight) * p(w), with f the value of a count's
    level, d(v) the sum of f(v, w) over all words seen after v, and p(w) = (f(w) + 0.1) / (sum of f + 0.1 (V + 1)); p(w)
    alone after words never seen before another. So the probabilities after each context add up to one. Every pair of
    the training texts is kept.

    Levels of pairs are read from the filter. It has 2**bits bits; by default each part has the power of two for which a
    missing level seems held at a rate of at most false_rate. There are as many parts as training tokens ask for, more
    if else one had over 2**most_bits bits. Levels of words are those of the counts that the base score takes: those of
    the `head` most frequent words are broadcast, those of other words are joined. Neither most_bits nor head changes a
    result. Words are told apart by 64-bit hashes, the words after one word by 40-bit ones, which adds less to the filter's
    false hits than 2**-16 of a part's pairs.

    Cases: null and empty texts are one end token; rows without doc_id are neither learned from nor held out;
    repeated rows count each and score alike; an empty table gives no rows; with nothing learned, N and V are 0.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("dig"), F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train = docs.where(fold != held_fold).select(F.col(text_col).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for _, w, _ in _texts(batch.column(0)):
                tally.add(np.concatenate([w.hash, np.full(len(w.first) - 1, _END)]))
                yield from tally.batches(1 << 20)
        yield from tally.batches()

    counts = tables.cut(train.mapInArrow(words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))
    n, v, kept = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(_value(F.col("c"))), F.lit(0.0))).first()
    mass, model_mass = n + 0.1 * (v + 1), kept + 0.1 * (v + 1)
    special = {r["h"]: r["c"] for r in counts.where(F.col("h") == int(signed(np.array([_END]))[0])).collect()}
    ends = next(iter(special.values()), 0)

    # counts fall into at most a few hundred classes; the largest classes that fit make up the head
    scale = F.floor(F.log2("c") * 8)
    total, lowest = 0, 1 << 30
    for r in counts.groupBy(scale.alias("q")).count().orderBy(F.desc("q")).collect():
        total += r["count"]
        if total > head:
            break
        lowest = r["q"]
    top = counts.where(scale >= lowest).toArrow()
    keys, c = top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("c").to_numpy()
    order = np.argsort(keys)
    exact = tables.sent(spark, (keys[order], c[order]))
    complete = total <= head
    found = counts.where(F.col("c") > n / (1 << _HOT)).select("h").toArrow().column("h").to_numpy().astype(np.int64).view(np.uint64)
    hot = np.sort(np.append(found, [_START] if ends > n / (1 << _HOT) else []).astype(np.uint64))  # there are as many starts as ends
    skip = int(np.ceil(np.log2(max(1, n / _PART))))
    skip = max(skip, needed_bits(2 * n, false_rate) - most_bits)
    skip = max(0, min(skip, _ROUTE, n.bit_length() - 8, _ROUTE if bits is None else bits - _BLOCK))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, prev, word, _ in _gathered(batches):
            packed = _packed([(p, x) for p, x, _, _ in _dealt(prev, word, hot, skip)])
            yield pa.RecordBatch.from_arrays([*packed.values()], [*packed])

    def filled(table: pa.Table) -> pa.Table:
        v, of, pairs, c = _unpacked(table)
        contexts, place = np.unique(v, return_inverse=True)
        of, pairs, order, at = _distinct(place[of], pairs)
        c = np.add.reduceat(c[order], at)
        own = needed_bits(int(levels(c).sum()), false_rate) if bits is None else bits - skip
        part = Frequencies(own, skip)
        part.add(_keys(contexts, pairs, of, hot), c)
        sums, split = np.bincount(of, value(levels(c)), minlength=len(contexts)), _within(hot, contexts)[1]
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([own], pa.int32()), "cells": pa.array([part.words.tobytes()], pa.binary()), "v": pa.array([contexts[~split].tobytes()], pa.binary()), "d": pa.array([sums[~split].tobytes()], pa.binary()), "hot": pa.array([signed(contexts[split]).tolist()], pa.list_(pa.int64())), "sums": pa.array([sums[split].tolist()], pa.list_(pa.float64()))})

    parts = tables.cut(train.mapInArrow(counted, _PACKED).groupBy("part").applyInArrow(filled, "part int, bits int, cells binary, v binary, d binary, hot array<long>, sums array<double>"))
    sums = parts.select(F.inline(F.arrays_zip("hot", "sums"))).groupBy("hot").agg(F.sum("sums").alias("d")).toArrow()
    hot_sums = np.zeros(len(hot))
    hot_sums[_within(hot, sums.column("hot").to_numpy().astype(np.int64).view(np.uint64))[0]] = sums.column("d").to_numpy()

    turns = min(_TURNS, 1 << skip)

    def sent(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        """Packed tokens of the parts of one turn. Rows are told apart within a run, which has other numbers each time."""
        heads, head_counts = exact.value
        for run, (rows, prev, word, of) in enumerate(_gathered(batches)):
            size = sum(r.num_rows for r in rows)
            own, place = np.unique(word, return_inverse=True)
            at, known = _within(heads, own)
            c = np.where(known, head_counts[at] if len(heads) else 0, 0)
            c[own == _END], known[own == _END] = ends, True
            known |= complete
            level = np.where(known, np.where(c > 0, levels(c), 0), _OPEN).astype(np.uint8)
            parts = []
            for p, columns, one, tokens in _dealt(prev, word, hot, skip):
                if p % turns != turn:
                    continue
                q = level[place[one]]
                parts.append((p, columns | {"q": q, "open": own[place[one[q == _OPEN]]], "doc": of[tokens].astype(np.uint16), "doc_high": (of[tokens] >> 16).astype(np.uint16)}))
            packed = _packed(parts or [(turn, dict.fromkeys([*_KINDS, "q", "open", "doc", "doc_high"], level[:0]))])
            uid, many = (turn << 60) + (TaskContext.get().partitionId() << 28) + run, len(packed["part"])
            docs = {
                "id": pa.concat_arrays([r.column(0) for r in rows]),
                "dig": pa.concat_arrays([r.column(1) for r in rows]),
                "held_out": pa.concat_arrays([r.column(2) for r in rows]),
                "n_tokens": pa.array(np.bincount(of, minlength=size).astype(np.int64) * (turn == 0)),
                "n_known": pa.array(np.bincount(of, (c > 0)[place], minlength=size).astype(np.int64) * (turn == 0)),
                "base": pa.array(np.bincount(of, np.where(known, np.log10(c + 0.1), 0.0)[place], minlength=size) * (turn == 0)),
            }
            # the run's rows go with its first part
            lists = {k: pa.ListArray.from_arrays(pa.array([0] + [size] * many, pa.int32()), x, mask=pa.array([i > 0 for i in range(many)])) for k, x in docs.items()}
            columns = packed | {"uid": pa.array(np.full(many, uid))} | lists
            yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    names = ("id", "dig", "held_out", "n_tokens", "n_known", "base")
    listed = "id array<long>, dig array<long>, held_out array<boolean>, n_tokens array<long>, n_known array<long>, base array<double>"

    def read(table: pa.Table, part: pa.Table) -> pa.Table:
        held = Frequencies(part.column("bits")[0].as_py(), skip, _column(part, "cells", np.uint64)) if part.num_rows else None
        own, own_sums = _column(part, "v", np.uint64), _column(part, "d", np.float64)
        docs, logs, tails = [], [], []
        for i in range(table.num_rows):
            one = slice(i, i + 1)
            v, of, pairs, times = _unpacked(table, one)
            (at, there), (hot_at, split) = _within(own, v), _within(hot, v)
            d = np.where(there, own_sums[at] if len(own) else 0.0, 0.0)
            d[split] = hot_sums[hot_at[split]]
            d = d[of]
            f = held.read(_keys(v, pairs, of, hot)) if held else np.zeros(len(pairs))
            share = np.divide(weight * f, d, out=np.full(len(d), -1.0), where=d > 0)  # below 0: nothing was seen after it
            q, doc = _column(table, "q", np.uint8, one), _column(table, "doc", np.uint16, one) + (_column(table, "doc_high", np.uint16, one).astype(np.int64) << 16)
            single = (value(np.where(q == _OPEN, 0, q).astype(np.int64)) + 0.1) / model_mass
            log = np.where(q == _OPEN, 0.0, np.log10(np.minimum(np.where(d > 0, share + (1 - weight) * single, single), 1.0)))
            model = np.bincount(doc, np.repeat(log, times)).astype(np.float64)
            some = np.flatnonzero(model)
            docs.append(some.astype(np.uint32).tobytes())
            logs.append(model[some].tobytes())
            left = np.repeat(q == _OPEN, times)
            word = np.zeros(len(q), np.uint64)
            word[q == _OPEN] = _column(table, "open", np.uint64, one)
            tails.append([pa.array(doc[left].astype(np.int32)), pa.array(signed(np.repeat(word, times)[left])), pa.array(np.repeat(share, times)[left])])
        at = pa.array(np.append(0, np.cumsum([len(x[0]) for x in tails])).astype(np.int32))
        kinds = (pa.int32(), pa.int64(), pa.float64())
        tail = pa.ListArray.from_arrays(at, pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], kind), *(x[k] for x in tails)]) for k, kind in enumerate(kinds)], ["doc", "h", "share"]))
        return pa.table({"uid": table.column("uid"), "docs": pa.array(docs, pa.binary()), "logs": pa.array(logs, pa.binary()), "tail": tail} | {k: table.column(k) for k in names})

    scored = []
    for turn in range(turns):
        spark.sparkContext._jvm.System.gc()  # a step's shuffle may still be in use for a moment after it, when cut() asks for this
        tokens = rows.mapInArrow(lambda batches, turn=turn: sent(batches, turn), f"{_PACKED}, q binary, open binary, doc binary, doc_high binary, uid long, {listed}")
        own = parts.where(F.col("part") % turns == turn)
        scored.append(tables.cut(tokens.groupBy("part").cogroup(own.groupBy("part")).applyInArrow(read, f"uid long, docs binary, logs binary, tail array<struct<doc: int, h: long, share: double>>, {listed}")))
    scored = reduce(DataFrame.unionByName, scored)
    tables.drop(parts)
    exact.destroy()

    c = F.coalesce("c", F.lit(0))
    tail = scored.where(F.size("tail") > 0).select(F.col("uid").alias("u"), F.inline("tail")).join(counts.select(turned("h").alias("t"), "c"), turned("h") == F.col("t"), "left")
    single = (_value(c) + 0.1) / F.lit(float(model_mass))
    log = F.log10(F.least(F.when(F.col("share") < 0, single).otherwise(F.col("share") + (1 - weight) * single), F.lit(1.0)))
    tail = tail.groupBy("u", "doc").agg(F.sum((c > 0).cast("long")).alias("known"), F.sum(F.log10(c + 0.1)).alias("base"), F.sum(log).alias("model"))

    def summed(table: pa.Table, tail: pa.Table) -> pa.Table:
        docs = table.filter(table.column("id").is_valid()).combine_chunks()
        out = {k: docs.column(k).combine_chunks().flatten() for k in names}
        known, base = out["n_known"].to_numpy().copy(), out["base"].to_numpy().copy()
        model = np.bincount(_column(table, "docs", np.uint32), _column(table, "logs", np.float64), minlength=len(base)).astype(np.float64)  # whole numbers where all are empty
        at = tail.column("doc").to_numpy()
        known[at] += tail.column("known").to_numpy().astype(np.int64)
        base[at] += tail.column("base").to_numpy()
        model[at] += tail.column("model").to_numpy()
        return pa.table(out | {"n_known": pa.array(known), "base": pa.array(base), "model": pa.array(model)})

    out = scored.drop("tail").groupBy("uid").cogroup(tail.groupBy("u")).applyInArrow(summed, "id long, dig long, held_out boolean, n_tokens long, n_known long, base double, model double")
    own = F.sum((F.col("n_tokens") > 0).cast("int")).alias("own")
    out = out.groupBy("id", "dig", "held_out").agg(own, *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "model")])
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("own").cast("int"))).alias("_"))  # repeated rows were summed together
    each = lambda x: (F.col(x) / F.col("own"))
    return out.select(
        F.col("id").alias("doc_id"),
        "held_out",
        each("n_tokens").cast("long").alias("n_tokens"),
        each("n_known").cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (each("base") - each("n_tokens") * F.lit(float(np.log10(mass)))).alias("base_score"),
        each("model").alias("score"),
    )
