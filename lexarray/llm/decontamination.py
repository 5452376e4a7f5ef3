"""Benchmark decontamination: which words of which documents repeat benchmark items.

A prefix-filtered containment join. Every window of an item is a set of short shingles; a document that
holds the window holds all of them, so the necessary prefix is one shingle, the one that the corpus has
least often. Documents are joined on prefix shingles only; position and length bounds place the window
around the shingle, and its words are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexarray.llm import tables
from lexarray.llm.groups import turned
from lexarray.llm.kernels import ALNUM_WORDS, LOWER, Words, chunks, gram_of, signed

_HITS = "gram long, n long"
_NEAR = "id long, dig long, n_words long, gram long, pos long, c0 long, ctx string"


def _joined(data: np.ndarray, words: Words, a: int, b: int) -> str:
    return b" ".join(data[words.start[i] : words.end[i]].tobytes() for i in range(a, b)).decode()


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, size (words), words (joined by spaces) and grams (its shingles, in order) of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for i, _, data, at in chunks(batch.column(1), LOWER):
                w = Words(data, at, ALNUM_WORDS)
                for k in range(len(at) - 1):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    size = min(window, b - a)
                    q = min(shingle, size)
                    for s in range(a, b - size + 1 if size else a):
                        out.append((ids[i + k], size, _joined(data, w, s, s + size), [int(signed(gram_of(w.hash[p : p + q])[None])[0]) for p in range(s, s + size - q + 1)]))
            yield pa.RecordBatch.from_pylist([dict(zip(("item_id", "size", "words", "grams"), x)) for x in out], pa.schema([("item_id", pa.int64()), ("size", pa.int64()), ("words", pa.string()), ("grams", pa.list_(pa.int64()))]))

    return items.mapInArrow(run, "item_id long, size long, words string, grams array<long>").distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 13, shingle: int = 5, one_in: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and dig (xxhash64 of the text).

    Words are maximal runs of letters, digits and characters beyond ASCII, lower-cased in A-Z. A window is
    any run of window words of an item; an item with fewer, but not none, is one window. A word of a
    document inside an occurrence of a window is hit. contaminated: n_hit > 0 and one_in * n_hit >= n_words.

    Cases: null texts have no words; items without an id or without words are ignored, repeated items count
    once; rows without doc_id and repeated rows are judged as all others, by their own text; an empty
    benchmark contaminates nothing and an empty table gives no rows. Columns other than those named are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("dig"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null")
    windows = tables.cut(item_windows(items, window, shingle))
    grams = windows.select(F.posexplode("grams").alias("at", "gram"), "item_id", "size", "words")
    # short items have shingles of their own length; there are at most `shingle` lengths
    lengths = sorted(r[0] for r in windows.select(F.least("size", F.lit(shingle)).cast("int")).distinct().collect())
    every = tables.sent(spark, tables.bloom_of(grams.select("gram"), bits=23).words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = tables.Bloom(every.value)
        for batch in batches:
            held = []
            for _, _, data, at in chunks(batch.column(0), LOWER):
                w = Words(data, at, ALNUM_WORDS)
                for q in lengths:
                    g, whole = w.grams(q)
                    g = g[whole]
                    held.append(g[bloom.has(g)])
            found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(found)), pa.array(n.astype(np.int64))], ["gram", "n"])

    counts = rows.select("text").mapInArrow(count, _HITS).groupBy("gram").agg(F.sum("n").alias("n"))
    # a window one of whose shingles never occurs cannot occur; of the others the rarest shingle is the prefix
    known = grams.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = known.groupBy("item_id", "size", "words").agg(F.min(F.struct("n", "gram", "at")).alias("p")).where("p.n > 0")
    rare = tables.cut(rare.select("item_id", "size", "words", "p.gram", "p.at"))
    prefix = tables.sent(spark, tables.bloom_of(rare.select("gram"), bits=23).words)
    reach = max(0, window - shingle)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = tables.Bloom(prefix.value)
        for batch in batches:
            digs = batch.column(1).to_numpy()
            total = np.zeros(len(digs), np.int64)
            doc, gram, pos, c0, ctx = [], [], [], [], []
            for i, _, data, at in chunks(batch.column(2), LOWER):
                w = Words(data, at, ALNUM_WORDS)
                n = np.diff(w.first)
                total[i : i + len(n)] = n
                of = np.repeat(np.arange(len(n)), n)
                for q in lengths:
                    g, whole = w.grams(q)
                    for p in np.flatnonzero(whole & bloom.has(g)) if len(g) else ():
                        d = of[p]
                        a, b = int(w.first[d]), int(w.first[d + 1])
                        x, y = (max(a, p - reach), min(b, p + window)) if q == shingle else (p, p + q)
                        doc.append(i + d)
                        gram.append(g[p])
                        pos.append(p - a)
                        c0.append(x - a)
                        ctx.append(_joined(data, w, x, y))
            of = np.concatenate([np.arange(len(digs)), np.array(doc, np.int64)])
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(total[of]),
                    pa.array(np.concatenate([digs, signed(np.array(gram, np.uint64))])),
                    pa.array(np.concatenate([np.full(len(digs), -1), np.array(pos, np.int64)])),
                    pa.array(np.concatenate([np.zeros(len(digs), np.int64), np.array(c0, np.int64)])),
                    pa.array([None] * len(digs) + ctx, pa.string()),
                ],
                ["id", "dig", "n_words", "gram", "pos", "c0", "ctx"],
            )

    # a document's own row (pos -1) goes with its candidates: no second join brings them together
    near = rows.mapInArrow(candidates, _NEAR)
    every.destroy()
    at = F.col("pos") - F.col("at")
    fits = (F.col("pos") >= 0) & (at >= F.col("c0")) & (at + F.col("size") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("ctx", " "), (at - F.col("c0") + 1).cast("int"), F.col("size").cast("int")), " ") == F.col("words")
    both = near.join(rare.select(turned("gram").alias("t"), "item_id", "size", "words", "at"), turned("gram") == F.col("t"), "left")
    hit = F.coalesce(F.when(fits, same), F.lit(False))
    both = both.select("id", "dig", "n_words", "pos", F.when(hit, at).alias("a"), F.when(hit, at + F.col("size")).alias("b"), F.when(hit, F.col("item_id").cast("string")).alias("item"))
    spans = F.collect_set(F.when(F.col("a").isNotNull(), F.struct("a", "b")))
    found = both.groupBy("id", "dig", "n_words").agg(F.sum((F.col("pos") == -1).cast("int")).alias("times"), F.sort_array(spans).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    # spans in order of their start: each adds what lies beyond the furthest end so far
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("e")), lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["e"]))).alias("n"), F.greatest(s["e"], x["b"]).alias("e")), lambda s: s["n"])
    found = found.select("id", "dig", "n_words", "times", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    found = found.select("*", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("_"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", ((F.col("n_hit") > 0) & (one_in * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "dig")


def uncontaminated(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that contamination() does not find contaminated, with all their columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = contamination(docs, items, **options).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("dig").alias("_bad_dig")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("d"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_dig"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad_id")) & (F.col("_dig") == F.col("_bad_dig")), "left_anti").select("d.*")
