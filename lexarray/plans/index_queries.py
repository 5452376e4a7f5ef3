"""Queries of the stored indexes: segments, inverted lists of vectors, trigrams; with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.operators import search
from lexarray.operators.cells import VectorCells
from lexarray.operators.segments import Segments
from lexarray.operators.trigrams import Trigrams
from lexarray.plans import search_queries
from lexarray.plans.search_queries import QUERY, TERMS
from lexarray.plans.sql_parts import TOKENS
from lexarray.plans.sql_parts import bm25 as bm25_sql
from lexarray.sources.corpus import table
from lexarray.sources.corpus import table
from lexarray.streaming.index import stream_segments

_KEPT: dict[tuple, str] = {}


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(spark.conf.get("spark.sql.warehouse.dir"), f"{name}-{uuid.uuid4()}")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return search_queries._docs(spark, sf).select(F.col("rowid").alias("doc"), F.col("file_path").alias("path"), "language", "content")


def stored_segments(spark: SparkSession, sf: str) -> Segments:
    """The documents as one segment, written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _KEPT:
        store = Segments(spark, _folder(spark, "segments"))
        store.add(texts=_texts(spark, sf))
        _KEPT[key] = store.folder
    return Segments(spark, _KEPT[key])


def bm25_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """The ranking of bm25_topk, from those ranges of documents only whose bound reaches it."""
    return search_queries._ranked(stored_segments(spark, sf).search(QUERY, 10))


def bm25_segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stored_segments(spark, sf).stats()


def changed_store(spark: SparkSession, sf: str) -> Segments:
    """Even documents are indexed; every sixth is removed while some odd ones are added; the other odd ones come in more commits,
    enough for a merge; last, some documents are replaced by their text twice over."""
    texts, store = _texts(spark, sf), Segments(spark, _folder(spark, "segments"))
    store.add(texts=texts.where("doc % 2 = 0"))
    store.add(texts=texts.where("doc % 8 = 1"), removed=texts.where("doc % 6 = 0").select("path"))
    for k in (3, 5, 7):
        store.add(texts=texts.where(f"doc % 8 = {k}"))
    twice = texts.where("doc % 10 = 1").withColumn("content", F.concat_ws(" ", "content", "content"))
    store.add(texts=twice, removed=twice.select("path"))
    return store


def bm25_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking over segments with tombstones equals that over what they come to."""
    store = changed_store(spark, sf)
    rows = store.search(QUERY, 10).collect()  # ten rows
    store.clear()
    return search_queries._ranked(spark.createDataFrame(rows, "doc long, score double"))


def segment_postings(spark: SparkSession, sf: str) -> DataFrame:
    """What the changed store holds live, by language."""
    store = changed_store(spark, sf)
    rows = store.postings().groupBy("language").agg(F.countDistinct("doc").alias("n_docs"), F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens")).collect()  # a row a language
    store.clear()
    return spark.createDataFrame(rows, "language string, n_docs long, n_postings long, n_tokens long")


def stream_upserts(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of files of documents, with changed, repeated and deleted ones, ends as a batch build of the last versions.

    A version has as many files as the table has splits. Files come in the order they were written, so a batch that takes files
    of two versions changes nothing: the last version of a path counts in it."""
    base = _folder(spark, "stream")
    texts = _texts(spark, sf)
    for version, rows in enumerate((texts, texts.where("doc % 5 = 0").withColumn("content", F.concat_ws(" ", "content", F.lit("changed"))), texts.where("doc % 7 = 0").withColumn("content", F.lit(None).cast("string")), texts.where("doc % 35 = 0"))):
        rows.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{base}/files")
        if not version:
            per_version = max(1, len(spark.read.parquet(f"{base}/files").inputFiles()))
    store = Segments(spark, f"{base}/store")
    files = spark.readStream.schema("doc long, path string, language string, content string, version int").option("maxFilesPerTrigger", per_version).parquet(f"{base}/files")
    stream_segments(files, store, f"{base}/checkpoint").awaitTermination()
    rows = store.documents().groupBy("language").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_tokens"), F.sum(F.array_contains("terms", "changed").cast("int")).alias("n_changed")).collect()  # a row a language
    path, fs = Segments(spark, base)._at(".")
    fs.delete(path, True)
    return spark.createDataFrame(rows, "language string, n_docs long, n_tokens long, n_changed long")


def vector_cells(spark: SparkSession, sf: str) -> VectorCells:
    """The embeddings as an inverted file, written once a session."""
    key = (spark.sparkContext.applicationId, sf, "cells")
    if key not in _KEPT:
        _KEPT[key] = VectorCells.write(table(spark, sf, "embeddings"), _folder(spark, "cells")).folder
    return VectorCells(spark, _KEPT[key])


def knn_all_cells(spark: SparkSession, sf: str) -> DataFrame:
    """With every cell probed the inverted file gives the exact answer."""
    cells, (_, q) = vector_cells(spark, sf), search_queries._vectors(spark, sf)
    return search_queries._near(cells.search(q, 10, probes=len(cells.centers)))


def knn_cells_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Of the default cells the nearest vector, which is the query itself."""
    cells, (_, q) = vector_cells(spark, sf), search_queries._vectors(spark, sf)
    return search_queries._near(cells.search(q, 1))


def _trigrams(spark: SparkSession, sf: str, name: str) -> Trigrams:
    """Trigrams of the documents or of the parts, written once a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        rows, fields = (search_queries._docs(spark, sf), ["content"]) if name == "documents" else (search_queries._parts(spark, sf), ["function_name", "return_type", "parameter_types", "class_name", "function_signature", "docstring", "content"])
        _KEPT[key] = Trigrams.write(rows, fields, _folder(spark, "trigrams")).folder
    return Trigrams(spark, _KEPT[key])


def keyword_grams(spark: SparkSession, sf: str) -> DataFrame:
    """keyword_search over the rows that hold the trigrams of the pattern, wildcards kept."""
    rows = _trigrams(spark, sf, "documents").narrowed([("content", "tion_the")])
    return search.keyword_search(rows, "tion_the", "en").select("file_path", "rowid")


def functions_grams(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trigrams(spark, sf, "part").narrowed([("function_name", "ring"), ("return_type", "STEEL"), ("parameter_types", 'e", "')])
    return search.search_functions(rows, "ring", "STEEL", ('e", "',), n=20).select("rowid", "function_name")


def metadata_grams(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("function_name", "class_name", "function_signature", "docstring", "return_type", "content")
    rows = _trigrams(spark, sf, "part").narrowed(any_of=[(f, "brass") for f in fields])
    return search.general_metadata(rows, "brass", 20).select("rowid", F.col("field_rank").cast("long").alias("field_rank"))


_FUNCTIONS = (bm25_pruned, bm25_segment_stats, bm25_segments, segment_postings, stream_upserts, knn_all_cells, knn_cells_nearest, keyword_grams, functions_grams, metadata_grams)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    top = "select doc_id, round(score, 6) score from bm"
    part = "part as (select doc_id, lang, text, case when doc_id % 10 = 1 then list_concat(terms, terms) else terms end terms from tok where doc_id % 2 = 1 or doc_id % 3 <> 0)"
    last = "last as (select doc_id, lang, case when doc_id % 35 <> 0 and doc_id % 5 = 0 then list_concat(terms, ['changed']) else terms end terms from tok where doc_id % 7 <> 0 or doc_id % 35 = 0)"
    held = lambda p: [f"{x} ilike '%{p}%'" for x in ("p_name", "p_brand", "'def ' || p_name || ' ' || p_type")] + [f"p_type ilike '%{p}%'"]
    name, brand, signature, kind = held("brass")
    return {
        "knn_all_cells": search_queries.knn_sql(),
        "knn_cells_nearest": search_queries.knn_sql(k=1),
        "keyword_grams": search_queries.oracle_sql()["keyword_search"],
        "functions_grams": f"select p_partkey rowid, p_name function_name from part where p_name ilike '%ring%' and p_type ilike '%STEEL%' and '[\"' || replace(p_name, ' ', '\", \"') || '\"]' ilike '%e\", \"%' order by {search_queries._NONE} nulls first, p_partkey limit 20",
        "metadata_grams": f"select p_partkey rowid, cast(case when {name} then 1 when {brand} then 2 when {signature} then 3 else 4 end as bigint) field_rank from part where {name} or {brand} or {signature} or {kind} order by field_rank, rowid limit 20",
        "bm25_pruned": f"with {TOKENS}, {bm25_sql(TERMS)} {top}",
        "bm25_segment_stats": search_queries.oracle_sql()["bm25_index_stats"],
        "bm25_segments": f"with {TOKENS}, {part}, {bm25_sql(TERMS, 'part')} {top}",
        "segment_postings": f"with {TOKENS}, {part}, u as (select doc_id, lang, unnest(terms) t from part), p as (select doc_id, lang, t, count(*) tf from u group by doc_id, lang, t) select lang as language, count(distinct doc_id) n_docs, count(*) n_postings, cast(sum(tf) as bigint) n_tokens from p group by lang",
        "stream_upserts": f"with {TOKENS}, {last} select lang as language, count(*) n_docs, cast(sum(len(terms)) as bigint) n_tokens, cast(sum(case when list_contains(terms, 'changed') then 1 else 0 end) as bigint) n_changed from last group by lang",
    }
