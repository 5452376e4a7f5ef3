"""Adapters of tables to the chunk schema and to vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("file_path", "content")]
    + [T.StructField(n, T.IntegerType()) for n in ("start_line", "end_line")]
    + [T.StructField(n, T.StringType()) for n in ("language", "semantic_type")]
    + [T.StructField("embedding", T.ArrayType(T.FloatType()))]
    + [T.StructField(n, T.StringType()) for n in ("chunk_type", "parent_chunk_id")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("dependencies", "dependents", "parameter_types", "inheritance_chain", "import_statements", "interfaces", "decorators")]
    + [T.StructField("complexity_score", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("function_signature", "class_name", "function_name", "return_type", "docstring", "content_hash", "file_hash")]
    + [T.StructField("created_at", T.TimestampType())]
)


def dealt(rows: DataFrame, *key: str) -> DataFrame:
    """Rows over all tasks of a shuffle. A table in one file with few row groups would be read by as few tasks, and what is
    made of its rows would be worked on, and held, by these."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_from_documents(documents: DataFrame) -> DataFrame:
    """One chunk a document; rowid is the order of insertion."""
    return documents.select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"),
        F.col("text").alias("content"),
        F.lit(1).alias("start_line"),
        F.size(F.split("text", "\n")).alias("end_line"),
        F.col("lang").alias("language"),
        F.lit("text").alias("semantic_type"),
        F.col("doc_id").alias("rowid"),
        F.col("n_chars").alias("complexity_score"),
    )


def chunks_from_conversations(conversations: DataFrame) -> DataFrame:
    """A conversation is a file, its turns are the chunks."""
    return conversations.select(F.concat(F.lit("conv/"), F.col("conv_id").cast("string")).alias("file_path"), F.col("turn").cast("int").alias("start_line"), F.col("role").alias("semantic_type"), F.col("text").alias("content"), (F.col("conv_id") * 1000 + F.col("turn")).alias("rowid"))


def chunks_from_parts(parts: DataFrame) -> DataFrame:
    """Parts as chunks of Python files, a file for each type, noun and brand: functions and classes that import, inherit and call."""
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    is_function = F.col("p_size") <= 30
    name = F.concat(a, F.lit("_"), b)
    return parts.select(
        F.col("p_partkey").alias("rowid"),
        F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), b, F.lit("_"), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit(".py")).alias("file_path"),
        F.col("p_partkey").cast("int").alias("start_line"),
        (F.col("p_partkey") + 1).cast("int").alias("end_line"),
        F.lit("python").alias("language"),
        F.when(is_function, "function_definition").otherwise("class_definition").alias("semantic_type"),
        F.when(is_function, name).alias("function_name"),
        F.when(~is_function, F.when(F.col("p_size") % 2 == 0, b).otherwise(a)).alias("class_name"),
        F.when(F.col("p_size") > 40, F.array(a)).alias("inheritance_chain"),
        F.array(F.concat(F.lit("import "), b, F.lit(".x")), F.concat(F.lit("from "), b, F.lit("_1 import y"))).alias("import_statements"),
        F.array(a, F.lower("p_type")).alias("dependencies"),
        F.concat(F.lit("def "), name, F.lit("(x):\n    return red_"), b, F.lit("(x)")).alias("content"),
    )
