"""Tables of a fixed size that every task adds to and that are then sent to all workers.

A table has 2**bits cells whatever the input is, so what is collected and broadcast has a bound that
is a parameter. Tasks emit compressed blocks of cells; the merge streams over them, block by block.
"""

from __future__ import annotations

import math
import os
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.llm.kernels import mix

_BLOCK = 1 << 16
_SCHEMA = "block int, cells binary"


def emit(cells: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's own cells, without blocks that are all zero."""
    blocks = [(b, cells[b * _BLOCK : (b + 1) * _BLOCK]) for b in range(math.ceil(len(cells) / _BLOCK))]
    blocks = [(b, zlib.compress(np.ascontiguousarray(x).tobytes(), 1)) for b, x in blocks if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["block", "cells"])


def merge(parts: DataFrame, cells: int, dtype: type, add: bool, finish: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """All tasks' cells as one array, summed or or-ed. finish maps merged cells to what is collected."""
    blocks = math.ceil(cells / _BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(zlib.decompress(x.as_py()), dtype)
                if b not in held:
                    held[b] = x.astype(np.uint64 if add else dtype)
                elif add:
                    held[b] += x
                else:
                    held[b] |= x
        out = [(b, zlib.compress(finish(x).tobytes(), 1)) for b, x in held.items()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["block", "cells"])

    rows = parts.repartition(max(1, min(blocks, 16)), "block").mapInArrow(run, _SCHEMA).collect()  # at most one row a block
    kind = finish(np.zeros(1, np.uint64 if add else dtype)).dtype
    out = np.zeros(blocks * _BLOCK, kind)
    for r in rows:
        x = np.frombuffer(zlib.decompress(bytes(r["cells"])), kind)
        out[r["block"] * _BLOCK : r["block"] * _BLOCK + len(x)] = x
    return out[:cells]


class Bloom:
    """A Bloom filter of 2**bits bits over 64-bit keys, for numpy arrays of keys."""

    def __init__(self, words: np.ndarray, probes: int = 3) -> None:
        self.words, self.probes = words, probes
        self.mask = np.uint64(len(words) * 64 - 1)

    @staticmethod
    def empty(bits: int, probes: int = 3) -> Bloom:
        return Bloom(np.zeros(max(1, (1 << bits) // 64), dtype=np.uint64), probes)

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        h = mix(keys.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        step = (h >> np.uint64(17)) | np.uint64(1)
        for k in range(self.probes):
            yield (h + np.uint64(k) * step) & self.mask

    def add(self, keys: np.ndarray) -> None:
        for at in self._places(keys):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        return reduce(np.logical_and, ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0 for at in self._places(keys)))


#: Bits of the largest filter that is sent: 64 MB.
MOST_BITS = 29


def bloom_of(keys: DataFrame, bits: int | None = None, probes: int = 3) -> Bloom:
    """A filter of the values of one or more long columns. By default it has 16 to 32 bits a key, so that under 1% of other keys pass, and
    never more than 2**MOST_BITS: beyond 2**25 keys more others pass, which costs time but no result."""
    table = None
    if bits is None:
        if "held_in" not in vars(keys):
            keys = table = cut(keys)  # once for the count and the filter
        bits = min(MOST_BITS, max(16, 4 + math.ceil(math.log2(1 + keys.count() * len(keys.columns)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom.empty(bits, probes)
        for batch in batches:
            for column in batch.columns:
                own.add(column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        yield from emit(own.words)

    merged = merge(keys.mapInArrow(run, _SCHEMA), len(Bloom.empty(bits).words), np.uint64, add=False)
    drop(table)
    return Bloom(merged, probes)


def split_by(df: DataFrame, key: Column, words: Broadcast) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key, a long, is surely not in a filter, and the others: only these need a join with what it holds."""

    @F.pandas_udf("boolean")
    def maybe(keys):  # noqa: ANN001, ANN202
        return pd.Series(Bloom(words.value).has(keys.to_numpy().astype(np.int64).view(np.uint64)))

    flagged = df.withColumn("_maybe", maybe(key))
    return flagged.where("not _maybe").drop("_maybe"), flagged.where("_maybe").drop("_maybe")


def sent(spark: SparkSession, value: object):
    """A broadcast of something whose size a parameter bounds."""
    return spark.sparkContext.broadcast(value)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's spark.checkpoint.dir, or where none is set one beside the warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))
    return sc.getCheckpointDir()


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """df computed once into a table in the shared folder, so that lost executors cost no more than their tasks.

    A later step reads only the columns it needs, in as many tasks as their bytes ask for. The shuffles of what was
    computed are not needed again; the collection lets Spark delete their files now and not at some later time.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_in = path
    spark.sparkContext._jvm.System.gc()
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables that cut() wrote and that no later step reads."""
    for t in tables:
        if t is not None:
            delete(t.sparkSession, t.held_in)


def level(counts: np.ndarray) -> np.ndarray:
    """Counts on a log scale in one byte, eight steps an octave."""
    return np.minimum(255, np.round(8 * np.log2(1.0 + counts.astype(np.float64)))).astype(np.uint8)

