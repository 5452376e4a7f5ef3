"""N-gram Jaccard join: which documents have nearly the same set of word shingles.

Rare-first prefix filtering. Shingles are ordered by how often they occur in the corpus, read from a
counting table of fixed size (any order that all documents share is exact; the counts only make it
selective). Two sets that reach the threshold share a shingle of their prefixes, so only documents with a
common prefix shingle are compared, after length, positional and suffix filters, and each pair once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarray.llm import groups, tables
from lexarray.llm.kernels import LOWER, SPACED_WORDS, Words, chunks, mix, shingles, signed


def _sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, _, data, at in chunks(column, LOWER):
        for k, s in enumerate(shingles(Words(data, at, SPACED_WORDS), n)):
            yield i + k, s


#: 64-bit words of a set's parities.
_PARITIES = 8


def _digest(s: np.ndarray) -> np.uint64:
    """Of a set; 64 bits name a set here, so that among n different sets two would be taken for one with odds of n * n / 2**65."""
    return mix(np.array([mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], dtype=np.uint64))[0]


def shingle_levels(texts: DataFrame, n: int, bits: int) -> np.ndarray:
    """For each of 2**bits cells how often its shingles occur in all texts, on a log scale of one byte."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, s in _sets(batch.column(0), n):
                held.append((s >> shift).astype(np.int64))
                size += len(s)
                if size > 1 << 21:
                    counts += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
                    held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << bits).astype(np.uint32)
        yield from tables.emit(counts)

    return tables.merge(texts.mapInArrow(run, "block int, cells binary"), 1 << bits, np.uint32, add=True, finish=tables.level)


def _parities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set the parities of how many of its shingles fall into each of some cells: two sets have at least as
    many shingles that are not common as they have parities that differ."""
    for batch in batches:
        out = np.zeros((batch.num_rows, _PARITIES), np.uint64)
        for i, s in enumerate(batch.column(1)):
            cells = np.bincount((mix(np.frombuffer(s.as_buffer(), np.uint64)) % np.uint64(64 * _PARITIES)).astype(np.int64), minlength=64 * _PARITIES) & 1
            out[i] = np.packbits(cells.astype(np.uint8), bitorder="little").view(np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(signed(out[:, j].copy())) for j in range(_PARITIES))], ["k", *(f"p{j}" for j in range(_PARITIES))])


def _classes(rows: DataFrame, n: int, percent: int, bits: int) -> tuple[DataFrame, DataFrame | None]:
    """(base, classes): id, dig, n and k of every row of rows (id, dig, text), n the size of its set and k the set's
    digest; and a table (k, c) of the sets that are linked with others, or None."""
    spark = rows.sparkSession
    levels = tables.sent(spark, shingle_levels(rows.select("text"), n, bits))
    shift = np.uint64(64 - bits)
    marked = rows.select("id", "dig", F.xxhash64("id", "dig").alias("r"), "text")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = levels.value
        known: set[int] = set()
        for batch in batches:
            rows_in = batch.num_rows
            size, key, sig = np.zeros(rows_in, np.int64), np.zeros(rows_in, np.uint64), np.zeros(rows_in, np.uint64)
            tokens: list[np.ndarray] = []
            for i, s in _sets(batch.column(3), n):
                m = len(s)
                size[i] = m
                listed = None
                if m:
                    key[i] = _digest(s)
                    if int(key[i]) not in known:  # copies of what this task has seen have nothing to add
                        known.add(int(key[i]))
                        quarters = np.minimum(0xFFFF, np.diff(np.append(np.searchsorted(s, _QUARTERS), m))).astype(np.uint64)
                        sig[i] = (quarters << _SHIFTS).sum(dtype=np.uint64)
                        order = np.argsort(table[(s >> shift).astype(np.int64)], kind="stable")  # s is sorted: ties go by hash
                        listed = signed(s[order[: m - -(-percent * m // 100) + 1]])
                tokens.append(listed)
            starts = np.zeros(rows_in + 1, np.int32)
            np.cumsum([0 if t is None else len(t) for t in tokens], out=starts[1:])
            flat = np.concatenate([np.zeros(0, np.int64), *[t for t in tokens if t is not None]])
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat), mask=pa.array([t is None for t in tokens], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size), pa.array(signed(key)), pa.array(signed(sig)), lists], ["id", "dig", "r", "n", "k", "sig", "tokens"])

    listed = tables.cut(marked.mapInArrow(prefixes, "id long, dig long, r long, n long, k long, sig long, tokens array<long>"))
    levels.destroy()

    def near(x: str, y: str) -> Column:
        nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
        most = F.least(nx - F.col(f"{x}.pos"), ny - F.col(f"{y}.pos"))
        suffix = sum(F.least(_quarter(f"{x}.sig", q), _quarter(f"{y}.sig", q)) for q in range(4))
        length = 100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)
        return length & ((100 + percent) * most >= percent * (nx + ny)) & ((100 + percent) * suffix >= percent * (nx + ny))

    members = groups.candidates(listed, "n", ["sig"], percent, F.col("r"), placed=True)
    base = tables.cut(listed.select("id", "dig", "r", "n", "k"))
    tables.drop(listed)

    def prepare(keys: DataFrame) -> tuple[Callable[[DataFrame], DataFrame], DataFrame]:
        # a set is read from one row: that with the least mark of those that have it
        asked = keys.select(groups.turned("k").alias("t"))
        chosen = base.where("n > 0").groupBy("k").agg(F.min("r").alias("r")).join(asked, groups.turned("k") == F.col("t"), "left_semi")
        wanted = tables.sent(spark, tables.bloom_of(chosen.select(F.col("r").bitwiseXOR(F.col("k")))).words)
        held.append(tables.cut(marked.select("r", "text").mapInArrow(lambda batches: full(batches, wanted), "k long, s binary")))
        wanted.destroy()
        return verify, held[0].mapInArrow(_parities, "k long, " + ", ".join(f"p{i} long" for i in range(_PARITIES)))

    held: list[DataFrame] = []

    def full(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
        bloom = tables.Bloom(wanted.value)
        known: set[int] = set()
        for batch in batches:
            marks = batch.column(0).to_numpy().view(np.uint64)
            keys, sets = [], []
            for i, s in _sets(batch.column(1), n):
                if len(s):
                    k = _digest(s)
                    if int(k) not in known and bloom.has(np.array([marks[i] ^ k]))[0]:
                        known.add(int(k))
                        keys.append(k)
                        sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.array(keys, np.uint64))), pa.array(sets, pa.binary())], ["k", "s"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(ok))

    def verify(pairs: DataFrame) -> DataFrame:
        ends = tables.sent(spark, tables.bloom_of(pairs.select("a", "b")).words)
        _, few = tables.split_by(held[0], F.col("k"), ends)
        both = pairs.join(few.select(groups.turned("k").alias("ta"), F.col("s").alias("sa")), groups.turned("a") == F.col("ta"))
        both = both.join(few.select(groups.turned("k").alias("tb"), F.col("s").alias("sb")), groups.turned("b") == F.col("tb"))
        found = tables.cut(both.select("a", "b", "sa", "sb").mapInArrow(alike, "a long, b long"))
        ends.destroy()
        return found

    def closer(x: str, y: str) -> Column:
        apart = sum(F.bit_count(F.col(f"{x}.p{i}").bitwiseXOR(F.col(f"{y}.p{i}"))) for i in range(_PARITIES))
        return (100 + percent) * apart <= (100 - percent) * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    labels = groups.linked(members, near, prepare, closer)
    tables.drop(*held)
    return base, labels


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("dig"), F.col(text_col).alias("text"))


def _placed(base: DataFrame, labels: DataFrame | None) -> DataFrame:
    """id, dig, n, k and c, the class, of every row of base; c is null without words."""
    own = base.select("id", "dig", "n", "k")
    alone = F.when(F.col("n") > 0, F.col("k"))
    if labels is None:
        return own.withColumn("c", alone)
    joined = own.join(labels.select(groups.turned("k").alias("t"), "c"), (groups.turned("k") == F.col("t")) & (F.col("n") > 0), "left")
    return joined.select("id", "dig", "n", "k", F.coalesce("c", alone).alias("c"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bits: int = 22) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (size of its set), component_id.

    Words are maximal runs without ASCII white space, lower-cased in A-Z. A document's set holds its
    distinct n-word shingles; with fewer words, all words as one. Two documents link when the
    intersection has at least percent % of the union; component_id is the smallest doc_id reachable.

    Cases: null or wordless texts have an empty set, link with nothing and are their own component. Rows
    without doc_id link as others do, but give their component no id: it is null where none has one. Repeated rows
    and exact copies share a component. Rows that repeat a doc_id with different texts are each placed by their text.
    An empty table gives no rows. Other columns of docs, whatever their names, are ignored. The filters hold for
    sets of any size; nothing is capped.
    """
    base, labels = _classes(_rows(docs, id_col, text_col), n, percent, bits)
    placed = _placed(base, labels)
    least = placed.where("c is not null").groupBy("c").agg(F.min("id").alias("component"), F.count("*").alias("of")).where("of > 1")
    out = placed.join(least.select(groups.turned("c").alias("t"), "component"), groups.turned("c") == F.col("t"), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


#: Where the quarters of the hash range begin, and their places in the packed counts.
_QUARTERS = np.array([0, 1 << 62, 1 << 63, 3 << 62], dtype=np.uint64)
_SHIFTS = np.array([0, 16, 32, 48], dtype=np.uint64)


def _quarter(sig: str, q: int) -> Column:
    """How many shingles have hashes of a quarter of the range; beyond 16 bits without bound."""
    x = F.shiftrightunsigned(F.col(sig), 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))
    return F.when(x == 0xFFFF, F.lit(1 << 40)).otherwise(x)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bits: int = 22) -> DataFrame:
    """One row of docs of each component: that with the smallest id, and of equal ids the smallest digest of the text.

    Cases: rows without id come last in that order; of rows with equal id and text the one with the smallest hash of
    all columns stays; rows without words belong to no component and all stay; an empty table gives no rows.
    """
    base, labels = _classes(_rows(docs, id_col, text_col), n, percent, bits)
    row = F.struct(F.col("id").isNull().alias("last"), "id", "dig")
    placed = _placed(base, labels).where("c is not null").select("c", row.alias("row"))
    least = placed.groupBy("c").agg(F.min("row").alias("least"), F.count("*").alias("of")).where("of > 1")
    shared = placed.join(least.select(groups.turned("c").alias("t"), "least"), groups.turned("c") == F.col("t")).groupBy("row").agg(F.first("least").alias("least"), F.count("*").alias("of"))
    shared = shared.where(~F.col("row").eqNullSafe(F.col("least")) | (F.col("of") > 1))
    shared = tables.cut(shared.select(F.col("row.id").alias("_id"), F.col("row.dig").alias("_dig"), F.col("row").eqNullSafe(F.col("least")).alias("_first")))
    tables.drop(base, labels)
    marks = tables.sent(docs.sparkSession, tables.bloom_of(shared.select(F.xxhash64("_id", "_dig"))).words)
    # only rows of larger components are shuffled
    out = docs.select(F.struct(*docs.columns).alias("d"), F.col(id_col).cast("long").alias("_i"), F.xxhash64(text_col).alias("_d"))
    whole, others = tables.split_by(out, F.xxhash64("_i", "_d"), marks)
    others = others.join(shared, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_dig")), "left").where("_first is null or _first")
    repeated = others.where("_first").groupBy("_i", "_d").agg(F.min_by("d", F.xxhash64("d")).alias("d"))
    return whole.select("d.*").unionByName(others.where("_first is null").select("d.*")).unionByName(repeated.select("d.*"))
