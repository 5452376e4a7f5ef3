"""Change detection, index maintenance and migration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["file_path", "start_line", "end_line"]


def detect_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status) of files deleted, new or modified: a newer time and another hash than recorded.

    stored: path, last_indexed, file_hash; current: path, modified, file_hash.
    """
    a = stored.select("path", F.col("last_indexed").alias("t0"), F.col("file_hash").alias("h0"), F.lit(True).alias("in0"))
    b = current.select("path", F.col("modified").alias("t1"), F.col("file_hash").alias("h1"), F.lit(True).alias("in1"))
    status = F.when(F.col("in1").isNull(), "deleted").when(F.col("in0").isNull(), "new").when((F.col("t1") > F.col("t0")) & ~F.col("h0").eqNullSafe(F.col("h1")), "modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def first_of_key(chunks: DataFrame) -> DataFrame:
    """Of chunks with the same key one."""
    return chunks.dropDuplicates(KEY)


def insert_new(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """index with the chunks whose key it lacks: the first writer of a key wins."""
    once = chunks.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("rowid"))).where("_n = 1").drop("_n")
    return index.unionByName(once.join(index.select(*KEY), KEY, "left_anti"), allowMissingColumns=True)


def remove_files(index: DataFrame, paths: DataFrame) -> DataFrame:
    return index.join(paths.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")


def apply_changes(index: DataFrame, changes: DataFrame, chunks: DataFrame) -> DataFrame:
    """index without the chunks of deleted and modified files, with the chunks given of modified and new ones."""
    kept = remove_files(index, changes.where("status in ('deleted', 'modified')"))
    fresh = chunks.join(changes.where("status in ('modified', 'new')").select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return insert_new(kept, fresh)


def migrate(legacy: DataFrame) -> DataFrame:
    """Legacy rows with their vectors read from JSON text; rows without a vector or with an undecodable one are left out."""
    return legacy.withColumn("embedding", F.from_json(F.col("embedding").cast("string"), "array<float>")).where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))


def verify_migration(legacy: DataFrame, migrated: DataFrame) -> DataFrame:
    counts = legacy.agg(F.count("*").alias("total"), F.count("embedding").alias("with_vector"))
    return counts.crossJoin(migrated.agg(F.count("*").alias("migrated"))).withColumn("complete", F.col("migrated") >= F.col("with_vector"))


def evolve(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with the columns they lack, null."""
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in rows.columns})
