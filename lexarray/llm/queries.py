"""The queries opN_<name>, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.llm import sql
from lexarray.llm.centroids import centroid_clusters
from lexarray.llm.decontamination import contamination
from lexarray.llm.html import extracted
from lexarray.llm.language import identify
from lexarray.llm.lines import line_dedup
from lexarray.llm.lm import lm_scores
from lexarray.llm.merkle import folded, merkle_manifest, siblings
from lexarray.llm.mixing import mixed
from lexarray.llm.ngram_join import ngram_components
from lexarray.llm.quality import quality_rules
from lexarray.llm.secrets import secret_spans
from lexarray.llm.tokens import token_counts
from lexarray.llm.warc import archived


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("dig")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_table(spark, sf_dir, "documents")).select("d.doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents")).select("d.doc_id", "n_lines", "n_dropped", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages")).drop("valid")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's crc32 three divides are presented with their text's A-Z in small letters."""
    docs = _table(spark, sf_dir, "documents")
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    presented = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, small).otherwise(F.col("text"))
    rows = merkle_manifest(docs, presented={"text": presented})
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded(F.col("shown"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only here, so that the other queries do not need it

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_html_extraction, op3_mixing, op4_quality_rules, op5_line_dedup, op6_warc, op7_language_id, op8_lm_scoring, op9_secret_scan, op10_ngram_jaccard_join, op11_merkle_manifest, op12_centroid_clustering, op13_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": sql.OP1, "op4_quality_rules": sql.OP4, "op6_warc": sql.OP6, "op10_ngram_jaccard_join": sql.OP10, "op11_merkle_manifest": sql.OP11, "op12_centroid_clustering": sql.OP12}
