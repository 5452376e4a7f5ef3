"""A trigram index for substring predicates: postings of three characters, intersected, then verified on the texts left."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block of postings.
_BLOCK = 256
#: Bytes of texts whose trigrams are held at once, unless one text has more.
_CHARS = 1 << 21
#: Candidates that a filter names, so that files skip other rows; more are joined.
NAMED = 1000
_POSTINGS = "field string, gram string, n int, rows array<long>"


def grams_of(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def pattern_grams(pattern: str) -> list[str]:
    """The trigrams that every text fitting %pattern% holds, in small letters; % and _ of the pattern are wildcards."""
    return sorted(set().union(*map(grams_of, re.split("[%_]", pattern.lower()))))


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where blocks of texts begin and end: of _BLOCK texts, or fewer if they have more than _CHARS bytes."""
    ends, a = pc.cumulative_sum(pc.binary_length(texts).cast(pa.int64())).to_numpy(), 0
    while a < len(texts):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _CHARS, side="right"))
        yield a, (b := min(max(a + 1, b), a + _BLOCK, len(texts)))
        a = b


def _held(texts: pa.Array, keys: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The different trigrams of some texts, in how many of them each is, and their keys. A trigram is one number of three
    code points."""
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy())
    inside = np.flatnonzero(of[2:] == of[:-2])
    coded = pa.array((points[:-2] << 42 | points[1:-1] << 21 | points[2:])[inside]).dictionary_encode()
    pair = np.sort(coded.indices.to_numpy().astype(np.int64) * _BLOCK + of[inside])
    pair = pair[np.append(True, pair[1:] != pair[:-1])[: len(pair)]]
    number = coded.dictionary.to_numpy()
    every = np.stack([number >> 42, number >> 21 & 0x1FFFFF, number & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    n = np.bincount(pair // _BLOCK, minlength=len(number)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), keys.take(pa.array(pair % _BLOCK)))
    return pa.array([every[i : i + 3] for i in range(0, len(every), 3)], pa.string()), pa.array(n), lists


class Trigrams:
    """Postings of the fields of a table by rowid, in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    @staticmethod
    def write(rows: DataFrame, fields: list[str], folder: str, key: str = "rowid") -> Trigrams:
        """Indexes text fields (arrays go by the text form they are searched in). The rows themselves are kept beside the
        postings, sorted by rowid, so that few of them can be read."""
        from lexarray.functions.text import json_array

        spark, kinds = rows.sparkSession, dict(rows.dtypes)
        rows.repartitionByRange(key).sortWithinPartitions(key).write.parquet(f"{folder}/rows")
        kept = spark.read.parquet(f"{folder}/rows")
        texts = [F.lower(json_array(F.col(f)) if kinds[f].startswith("array") else F.col(f)).alias(f"t{k}") for k, f in enumerate(fields)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, field in enumerate(fields):
                    texts = pc.fill_null(batch.column(k + 1), "")
                    for a, b in _runs(texts):
                        grams, n, own = _held(texts.slice(a, b - a), batch.column(0).slice(a, b - a))
                        yield pa.RecordBatch.from_arrays([pa.repeat(field, len(grams)), grams, n, own], ["field", "gram", "n", "rows"])

        blocks = kept.select(F.col(key).cast("long").alias("key"), *texts).mapInArrow(run, _POSTINGS)
        spread = F.element_at("rows", 1)  # a trigram of most texts is spread over ranges
        blocks.withColumn("first", spread).repartitionByRange("field", "gram", "first").sortWithinPartitions("field", "gram", "first").drop("first").write.parquet(f"{folder}/postings")
        return Trigrams(spark, folder)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    def candidates(self, field: str, pattern: str) -> DataFrame | None:
        """(key) of the rows whose field holds all trigrams of a pattern; None where the pattern has none."""
        grams = pattern_grams(pattern)
        if not grams:
            return None
        blocks = self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/postings").where((F.col("field") == field) & F.col("gram").isin(grams))
        return blocks.select("gram", F.explode("rows").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("key")

    def narrowed(self, all_of: list[tuple[str, str]] = (), any_of: list[tuple[str, str]] = (), key: str = "rowid") -> DataFrame:
        """The rows that can fit all of the (field, pattern) pairs and one of any_of: a search over them finds what it finds
        over the whole table. Patterns without a trigram narrow nothing."""
        found = [c for c in (self.candidates(*x) for x in all_of) if c is not None]
        either = [self.candidates(*x) for x in any_of]
        if either and all(c is not None for c in either):
            union = either[0]
            for c in either[1:]:
                union = union.unionByName(c)
            found.append(union.distinct())
        if not found:
            return self.rows
        keys = found[0]
        for c in found[1:]:
            keys = keys.join(c, "key", "left_semi")
        few = [r["key"] for r in keys.limit(NAMED + 1).collect()]
        return self.rows.where(F.col(key).isin(few)) if len(few) <= NAMED else self.rows.join(keys.withColumnRenamed("key", key), key, "left_semi")
