"""Reciprocal rank fusion and per-file diversity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60


def fuse(legs: list[DataFrame], key: str = "doc", k: int = K) -> DataFrame:
    """(key, score, first_leg, first_rank) of the rows of several rankings (key, rank from 1), best first by score.

    A row scores 1 / (k + rank) for each place it has in a leg; ties go to the leg, then the rank, that saw it first.
    """
    rows = reduce(DataFrame.unionByName, [leg.select(key, "rank", F.lit(i).alias("leg")) for i, leg in enumerate(legs)])
    first = F.min(F.struct("leg", "rank"))
    out = rows.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), first.alias("first"))
    return out.select(key, "score", F.col("first.leg").alias("first_leg"), F.col("first.rank").alias("first_rank"))


def ranked(rows: DataFrame, *order: object) -> DataFrame:
    """A short ranking's rows with their rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def diverse(rows: DataFrame, file_col: str, *order: object, most: int = 3) -> DataFrame:
    """At most `most` rows of each file, the first in order."""
    return rows.withColumn("in_file", F.row_number().over(Window.partitionBy(file_col).orderBy(*order))).where(F.col("in_file") <= most).drop("in_file")
