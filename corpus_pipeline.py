"""A corpus pipeline of the training-data operators: STAGES in order, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents. run() writes each
stage's result as Parquet in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexarray.llm import tables
from lexarray.llm.decontamination import uncontaminated
from lexarray.llm.lines import deduped
from lexarray.llm.mixing import mixture
from lexarray.llm.ngram_join import one_of_each
from lexarray.llm.quality import passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are nearly the same one occurrence stays; documents with nothing left go."""
    return deduped(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest doc_id, then the smallest digest."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics have their target shares of tokens."""
    return mixture(docs, fraction=0.7)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]

#: Fuzzy line groups and iterated weights are not expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables.shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        if k:
            tables.delete(spark, f"{folder}/{k - 1}")  # what the stage before left has been read
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
