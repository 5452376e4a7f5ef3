"""Queries of the tools' façade over a table of code chunks with vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.api import Engine
from lexarray.operators import bm25
from lexarray.plans.sql_parts import DISTANCE, TOKENS
from lexarray.plans.sql_parts import bm25 as bm25_sql
from lexarray.sources.corpus import chunks_from_parts, table

#: A question whose words call for the metadata leg, and which is routed to functions by name.
QUESTION = "function cold_widget"


def _engine(spark: SparkSession, sf: str) -> Engine:
    """Parts as chunks of code, with the vectors of equal number where there are any; all questions have that of vector 0."""
    vectors = table(spark, sf, "embeddings")
    asked = list(vectors.where("vec_id = 0").first()["embedding"])
    chunks = chunks_from_parts(table(spark, sf, "part")).withColumn("complexity_score", F.length("content"))
    chunks = chunks.join(vectors.select(F.col("vec_id").alias("rowid"), "embedding"), "rowid", "left")
    return Engine(chunks, lambda query: asked)


def tool_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """BM25, vectors and metadata fused, three chunks a file at most."""
    found = _engine(spark, sf).hybrid(QUESTION, "python", 30, 0.0)
    return found.select("rowid", "file_path", F.round("score", 8).alias("score"))


def tool_semantic(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks at least so similar to a question."""
    return _engine(spark, sf).semantic(QUESTION, "python", 40, 0.1).select("rowid", "file_path", F.round("distance", 6).alias("distance"))


def queries() -> dict:
    return {f.__name__: f for f in (tool_hybrid, tool_semantic)}


_CODE = """k as (select p_partkey as rowid, 'src/' || lower(p_type) || '/' || b || '_' || replace(p_brand, 'Brand#', '') || '.py' file_path, a || '_' || b f, p_size <= 30 is_f, 'def ' || a || '_' || b || '(x):' || chr(10) || '    return red_' || b || '(x)' content
  from (select *, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) b from part)),
texts as (select rowid doc_id, 'python' lang, content text from k)"""
_NEAR = f"v as (select vec_id as rowid, cast(embedding as double[]) e, (select cast(embedding as double[]) from embeddings where vec_id = 0) q from embeddings), near as (select k.rowid, file_path, {DISTANCE['cosine']} distance from v join k on v.rowid = k.rowid)"


def oracle_sql() -> dict[str, str]:
    words = f"{TOKENS.replace('from documents', 'from texts')}, {bm25_sql(bm25.query_terms(QUESTION), n=50)}"
    legs = """legs as (select doc_id as rowid, row_number() over (order by score desc, doc_id) rank, 0 leg from bm
union all select * from (select rowid, row_number() over (order by distance, rowid) rank, 1 from near where distance <= 1 qualify rank <= 30)
union all select * from (select rowid, row_number() over (order by length(content), rowid) rank, 2 from k where is_f and f ilike '%cold_widget%' qualify rank <= 50)),
fused as (select rowid, sum(1.0 / (60 + rank)) score, min(leg * 1000 + rank) first from legs group by rowid),
d as (select k.rowid, file_path, score, first, row_number() over (partition by file_path order by score desc, first) n from fused join k on fused.rowid = k.rowid)"""
    return {
        "tool_hybrid": f"with {_CODE}, {words}, {_NEAR}, {legs} select rowid, file_path, round(score, 8) score from d where n <= 3 order by d.score desc, first limit 30",
        "tool_semantic": f"with {_CODE}, {_NEAR} select rowid, file_path, round(distance, 6) distance from near where near.distance <= 0.9 order by near.distance, rowid limit 40",
    }
