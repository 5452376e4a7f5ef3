"""An inverted file of vectors: cells around k-means centers, vectors lie in folders by cell, a search reads few cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarray.operators import search

#: Rows that centers are learned from at most, drawn by a hash of the key; every row gets into a cell.
SAMPLE = 100_000
#: Cells are as many as the root of the rows, to this number.
MOST_CELLS = 4096
#: Rows that the number of probes is measured with, and the share of nearest rows that it is to find.
TRIALS, RECALL = 64, 0.95
#: Folders of a cell are written by so many tasks at most, so that a cell with most of the rows is no single task.
_SPREAD = 8


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, size, out=np.zeros_like(v), where=size > 0)


def _directions(vectors: Column) -> Column:
    """Vectors (not null) of unit length, by batches: in a column expression each component would add up the whole vector anew."""

    @F.arrow_udf("array<double>")
    def run(batch: pa.Array) -> pa.Array:
        if not len(batch):
            return pa.array([], pa.list_(pa.float64()))
        units = _unit(batch.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * units.shape[1], pa.int32()), pa.array(units.reshape(-1)))

    return run(vectors)


def learned(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", cells: int | None = None, seed: int = 0) -> np.ndarray:
    """Centers of unit length, by Spark's k-means over the vectors' directions; null vectors count for nothing."""
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).alias("_key"), F.col(column).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    if n > SAMPLE:
        rows = rows.where(F.pmod(F.xxhash64("_key"), F.lit(n)) < SAMPLE)
    units = rows.select(array_to_vector(_directions(F.col("v"))).alias("features"))
    k = min(cells or max(1, round(math.sqrt(n))), MOST_CELLS)
    if k == 1 or n < 2:
        return np.zeros((1, len(rows.first()["v"])))
    return _unit(np.array(KMeans(k=k, seed=seed, maxIter=10).fit(units).clusterCenters()))


def cell_of(vector: Column, centers: np.ndarray) -> Column:
    """The cell of a vector: that of the center with the largest product, the first of equals; null has none."""

    @F.arrow_udf("int")
    def run(batch: pa.Array) -> pa.Array:
        out = np.zeros(len(batch), np.int32)
        there = batch.is_valid().to_numpy(zero_copy_only=False)
        if there.any():
            flat = batch.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            out[there] = np.argmax(flat.reshape(-1, centers.shape[1]) @ centers.T, axis=1)
        return pa.array(out, mask=~there)

    return run(vector.cast("array<double>"))


def probed(centers: np.ndarray, query: list[float], probes: int) -> list[int]:
    """The cells whose centers are nearest to a query."""
    near = centers @ _unit(np.asarray(query, np.float64))
    return np.argsort(-near, kind="stable")[:probes].tolist()


def probes_for(rows: DataFrame, centers: np.ndarray, key: str, column: str, recall: float = RECALL, k: int = 10) -> int:
    """How many cells a search has to probe to find a share `recall` of the k nearest rows, measured on TRIALS rows as queries
    against all rows (key, column, cell): each task keeps k rows of each query."""
    asked = rows.orderBy(F.xxhash64(key), key).limit(TRIALS).select(F.col(column).cast("array<double>").alias("v")).collect()
    queries = _unit(np.array([r["v"] for r in asked]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(queries), k + 1), -np.inf)
        cells = np.zeros((len(queries), k + 1), np.int32)
        for batch in batches:
            v = _unit(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            near = np.concatenate([best, queries @ v.T], axis=1)
            own = np.concatenate([cells, np.broadcast_to(batch.column(1).to_numpy(), (len(queries), len(v)))], axis=1)
            top = np.argsort(-near, axis=1, kind="stable")[:, : k + 1]
            best, cells = np.take_along_axis(near, top, 1), np.take_along_axis(own, top, 1)
        there = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(there)[0].astype(np.int32)), pa.array(cells[there]), pa.array(best[there])], ["query", "cell", "near"])

    found = rows.select(F.col(column).cast("array<double>").alias("v"), "cell").mapInArrow(run, "query int, cell int, near double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "cell"))
    needed = []
    for r in found.withColumn("rank", rank).where(F.col("rank").between(2, k + 1)).collect():  # TRIALS * k rows; the first is the query itself
        order = np.argsort(-(centers @ queries[r["query"]]), kind="stable")
        needed.append(int(np.flatnonzero(order == r["cell"])[0]) + 1)
    return sorted(needed)[max(0, math.ceil(recall * len(needed)) - 1)] if needed else len(centers)


class VectorCells:
    """An inverted file in a folder: vectors/cell=N and the centers."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        rows = spark.read.parquet(f"{folder}/centers").orderBy("cell").collect()  # MOST_CELLS at most
        self.centers, self.probes = np.array([r["center"] for r in rows]), rows[0]["probes"] if rows else 0

    @staticmethod
    def write(vectors: DataFrame, folder: str, key: str = "vec_id", column: str = "embedding", cells: int | None = None) -> VectorCells:
        """Indexes every row with a vector; other columns come along."""
        spark = vectors.sparkSession
        centers = learned(vectors, key, column, cells)
        rows = vectors.where(F.col(column).isNotNull()).withColumn("cell", cell_of(F.col(column), centers))
        rows.repartition("cell", F.pmod(F.xxhash64(key), F.lit(_SPREAD))).write.partitionBy("cell").parquet(f"{folder}/vectors")
        probes = probes_for(spark.read.parquet(f"{folder}/vectors"), centers, key, column)
        spark.createDataFrame([(k, c.tolist(), probes) for k, c in enumerate(centers)], "cell int, center array<double>, probes int").write.parquet(f"{folder}/centers")
        return VectorCells(spark, folder)

    def search(self, query: list[float], k: int, metric: str = "cosine", probes: int | None = None, key: str = "vec_id", report: dict | None = None, **options: object) -> DataFrame:
        """The k nearest rows of the cells probed, as search.knn() gives them; all cells probed: exact. By default as
        many are probed as the index found to give RECALL of the nearest rows."""
        near = probed(self.centers, query, probes or self.probes)
        every = self.spark.read.parquet(f"{self.folder}/vectors")
        rows = every.where(F.col("cell").isin(near))  # prunes folders
        if report is not None:
            cell = lambda f: int(f.split("/cell=")[1].split("/")[0])
            report |= {"files": len(every.inputFiles()), "read": sum(cell(f) in near for f in every.inputFiles())}
        return search.knn(rows, query, k, metric, key=key, **options)
