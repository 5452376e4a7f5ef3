"""Queries of ranking, vectors, metadata search and statistics, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.functions import text, tokenise, vector
from lexarray.operators import bm25, search
from lexarray.plans.sql_parts import DISTANCE, RAW, TOKENS, VECTORS
from lexarray.plans.sql_parts import bm25 as bm25_sql
from lexarray.sources.corpus import chunks_from_conversations, chunks_from_documents, table

QUERY = "erblest inenan thorerou hein thanble onwh erblest"
TERMS = bm25.query_terms(QUERY)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_from_documents(table(spark, sf, "documents"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


_STORED: dict[tuple, str] = {}


def stored_index(spark: SparkSession, sf: str) -> bm25.Stored:
    """The inverted index of the documents, built once a session and state of the table, as a user builds it once before
    searching. It lies in the warehouse, which all executors share."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/documents.parquet")
    state = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    key = (spark.sparkContext.applicationId, sf, state.getModificationTime(), state.getLen())
    if key not in _STORED:
        path = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), f"bm25-{uuid.uuid4()}")
        bm25.Stored.write(bm25.build_counted(_docs(spark, sf)), path)
        _STORED[key] = path
    return bm25.Stored(spark, _STORED[key])


def bm25_build(spark: SparkSession, sf: str) -> DataFrame:
    """A new inverted index of the documents and what it holds."""
    path = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), f"bm25-{uuid.uuid4()}")
    built = bm25.Stored.write(bm25.build_counted(_docs(spark, sf)), path)
    docs = built.docs.where("dl > 0").agg(F.countDistinct("doc").alias("n_docs"))  # not from the postings, of which every file has nearly every document
    return built.postings.agg(F.count("*").alias("n_postings"), F.sum("tf").alias("n_tokens")).crossJoin(docs)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(stored_index(spark, sf).search(QUERY, 10))


def bm25_topk_lang(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(stored_index(spark, sf).search(QUERY, 10, language="en"))


def bm25_unstored(spark: SparkSession, sf: str) -> DataFrame:
    """The same ranking over texts that no index was built for."""
    return _ranked(bm25.search(bm25.build(_docs(spark, sf)), QUERY, 10))


def bm25_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stored_index(spark, sf).stats()


def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    return stored_index(spark, sf).postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Even documents are indexed, every third is then removed and the odd ones are added."""
    index = bm25.occurrences(stored_index(spark, sf).docs, QUERY)  # so that a change shuffles the query's counts, not all terms
    even = index.where("doc % 2 = 0")
    return _ranked(bm25.best(bm25.update(even, even.where("doc % 3 = 0").select("doc"), index.where("doc % 2 = 1")), QUERY, 10))


def token_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", tokenise.tokens(F.col("text")).alias("terms"))
    return rows.select("doc_id", F.size("terms").cast("long").alias("n_tokens"), F.size(F.array_distinct("terms")).cast("long").alias("n_distinct"), F.md5(F.array_join("terms", " ").cast("binary")).alias("digest"))


def identifier_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", tokenise.tokens(F.col("text"), raw=True).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


def strip_comments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", *[F.length(text.strip_comments(F.col("html"), lang)).cast("long").alias(f"n_{lang}") for lang in ("python", "javascript", "java", "go")])


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, list[float]]:
    rows = table(spark, sf, "embeddings")
    return rows, list(rows.where("vec_id = 0").first()["embedding"])


def _near(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _near(search.knn(*_vectors(spark, sf), 10))


def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    return _near(search.knn(*_vectors(spark, sf), 10, "l2"))


def knn_dot(spark: SparkSession, sf: str) -> DataFrame:
    return _near(search.knn(*_vectors(spark, sf), 10, "dot"))


def knn_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return _near(search.knn(*_vectors(spark, sf), 50, threshold=0.8))


def knn_lang_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    return _near(search.knn(*_vectors(spark, sf), 20, postfilter=F.col("label") < 3))


def knn_lang_prefilter(spark: SparkSession, sf: str) -> DataFrame:
    return _near(search.knn(*_vectors(spark, sf), 20, prefilter=F.col("label") < 3))


def quantize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(vector.quantize(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double"), 6).alias("x"))


def quantized_knn(spark: SparkSession, sf: str) -> DataFrame:
    rows, q = _vectors(spark, sf)
    return _near(search.knn(rows.withColumn("embedding", vector.quantize(F.col("embedding"))), q, 10))


def all_pairs_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.knn_of(queries, rows, 5).select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.keyword_search(_docs(spark, sf), "tion_the", "en").select("file_path", "rowid")


def search_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_by_type(chunks_from_conversations(table(spark, sf, "conversations")), "assistant").select("file_path", "start_line", "rowid")


def search_by_type_in_text(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_by_type(_docs(spark, sf).withColumn("semantic_type", F.when(F.col("rowid") % 2 == 0, "thand").otherwise("text")), "thand", in_text=True).select("file_path", "rowid")


def search_in_file(spark: SparkSession, sf: str) -> DataFrame:
    rows, q = _vectors(spark, sf)
    return _near(search.knn(rows, q, 5, prefilter=F.col("label") == 4))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as functions and suppliers as classes."""
    parts = table(spark, sf, "part")
    return parts.select(
        F.col("p_partkey").alias("rowid"),
        F.lit("function_definition").alias("semantic_type"),
        F.col("p_name").alias("function_name"),
        F.col("p_type").alias("return_type"),
        F.split("p_name", " ").alias("parameter_types"),
        F.concat_ws(" ", F.lit("def"), "p_name", "p_type").alias("function_signature"),
        F.col("p_brand").alias("class_name"),
        F.col("p_type").alias("docstring"),
        F.col("p_name").alias("content"),
        F.when(F.col("p_size") % 7 == 0, None).otherwise(F.col("p_size")).alias("complexity_score"),
        F.col("p_brand").alias("language"),
        F.split("p_type", " ").alias("inheritance_chain"),
        F.array("p_brand").alias("interfaces"),
    )


def search_functions(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_functions(_parts(spark, sf), name="a", returns="e", parameters=("r",), n=20).select("rowid", "function_name", F.col("complexity_score").cast("long").alias("complexity_score"))


def search_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf).withColumn("semantic_type", F.lit("class_definition"))
    return search.search_classes(rows, name="brand", inherits="a", implements="1", n=20).select("rowid", "class_name")


def search_imports(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    rows = pages.select(F.col("page_id").alias("rowid"), links.alias("import_statements"), F.array().cast("array<string>").alias("dependencies"), F.col("html").alias("content"), F.lit("html").alias("language"))
    return search.search_imports(rows, module="/the", uses="article", n=20).select("rowid")


def general_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return search.general_metadata(_parts(spark, sf), "in", 20).select("rowid", F.col("field_rank").cast("long").alias("field_rank"))


def metadata_router_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_metadata(_parts(spark, sf), "function ring", 20).select("rowid", "function_name")


def complexity_range(spark: SparkSession, sf: str) -> DataFrame:
    return search.complexity_range(_docs(spark, sf), 500, 3000, "fr", 30).select("rowid", "complexity_score")


def similar_signature(spark: SparkSession, sf: str) -> DataFrame:
    return search.similar_signatures(_parts(spark, sf), "def red(blue, async green)", 30).select("rowid", "function_name")


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy("language").agg(F.count("*").alias("n"), F.sum("complexity_score").alias("chars")).orderBy(F.desc("n"), "language")


def files_by_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_from_conversations(table(spark, sf, "conversations")).groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(15)


def index_status(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks_from_conversations(table(spark, sf, "conversations"))
    return rows.agg(F.count("*").alias("n_chunks"), F.countDistinct("file_path").alias("n_files"), F.max("start_line").cast("long").alias("last_line"), F.round(F.sum(F.octet_length("content")) / 1048576, 2).alias("size_mb"))


def query_type(spark: SparkSession, sf: str) -> DataFrame:
    asked = F.concat_ws(" ", F.element_at(F.array(*[F.lit(x) for x in ASKED]), (F.col("item_id") % len(ASKED) + 1).cast("int")), "text")
    return table(spark, sf, "benchmark").select("item_id", search.query_type(asked).alias("kind"))


#: Questions of each type, to put before a benchmark text.
ASKED = ("return type of", "Import of", "CLASS named", "a method", "any type", "where is")


#: What is put before a turn of a conversation to make a question that is routed or expanded.
ROUTED = ("function that returns", "functions named", "class that inherits from", "class", "import", "anything")
EXPANDED = ("user auth", "get DATA from config", "plain words", "delete error")


def _turns(spark: SparkSession, sf: str, before: tuple[str, ...]) -> DataFrame:
    rows = chunks_from_conversations(table(spark, sf, "conversations"))
    first = F.element_at(F.array(*[F.lit(x) for x in before]), (F.col("rowid") % len(before) + 1).cast("int"))
    return rows.select("rowid", F.concat_ws(" ", first, "content").alias("q"))


def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, EXPANDED).select("rowid", F.posexplode(search.expanded(F.col("q"))).alias("rank", "expanded"))


def query_router(spark: SparkSession, sf: str) -> DataFrame:
    return _turns(spark, sf, ROUTED).select("rowid", search.route_of(F.col("q")).alias("r")).select("rowid", "r.field", "r.value")


def knn_sql(metric: str = "cosine", k: int = 10, where: str = "", after: str = "") -> str:
    return f"with {VECTORS}, r as (select vec_id, label, {DISTANCE[metric]} distance from v), s as (select * from r {where} order by distance, vec_id limit {k}) select vec_id, label, round(distance, 6) distance from s {after}"


_TOP = "select doc_id, round(score, 6) score from bm"
_CHUNK = "source || '/' || doc_id || '.txt'"
_QUANTIZED = "list_transform(embedding, lambda x: cast(cast(trunc(cast(greatest(least(x, cast(1 as float)), cast(-1 as float)) * cast(127 as float) as float)) as float) / cast(127 as float) as float))"
_NONE = "case when p_size % 7 = 0 then null else p_size end"

_FUNCTIONS = (
    bm25_topk, bm25_topk_lang, bm25_unstored, bm25_build, bm25_index_stats, bm25_postings, bm25_incremental, token_stats, identifier_split, strip_comments, knn_cosine, knn_l2, knn_dot, knn_threshold, knn_lang_postfilter,
    knn_lang_prefilter, quantize, quantized_knn, all_pairs_cosine_topk, keyword_search, search_by_type, search_by_type_in_text, search_in_file, search_functions, search_classes, search_imports, general_metadata,
    metadata_router_search, complexity_range, similar_signature, corpus_stats, files_by_chunks, index_status, query_type, query_expansion, query_router,
)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    strip = {
        "python": ["'#[^\\n]*'", "'(?s)\"\"\".*?\"\"\"'", "'(?s)''''''.*?'''''''", "'\"[^\"]*\"'", "'''[^'']*'''"],
        "javascript": ["'//[^\\n]*'", "'(?s)/\\*.*?\\*/'", "'\"[^\"]*\"'", "'''[^'']*'''", "'`[^`]*`'"],
        "java": ["'//[^\\n]*'", "'(?s)/\\*.*?\\*/'", "'\"[^\"]*\"'"],
        "go": ["'//[^\\n]*'", "'(?s)/\\*.*?\\*/'", "'\"[^\"]*\"'", "'`[^`]*`'"],
    }

    def stripped(lang: str) -> str:
        out = "html"
        for p in strip[lang]:
            out = f"regexp_replace({out}, {p}, '', 'g')"
        return f"cast(len({out}) as bigint) n_{lang}"

    kinds = "case " + " ".join(f"when {' or '.join(f'contains(lower(a), {chr(39)}{w}{chr(39)})' for w in words)} then '{name}'" for name, words in search.QUERY_TYPES) + " else 'general_search' end"
    asked = "[" + ", ".join(f"'{x}'" for x in ASKED) + "]"
    turns = lambda before: f"a as (select conv_id * 1000 + turn rowid, concat_ws(' ', {list(before)}[cast((conv_id * 1000 + turn) % {len(before)} as int) + 1], text) q from conversations), l as (select rowid, q, lower(q) s from a)"
    more = ", ".join(f"case when contains(s, '{base}') and not contains(s, '{w}') then q || ' {w}' end" for base, words in search.EXPANSIONS.items() for w in words)
    in_sql = lambda p: p.replace(".", r"[^\n]").replace(r"\w", r"[\p{L}\p{N}_]")
    routed = lambda value, other: "case " + " ".join(f"when regexp_matches(s, '{in_sql(t)}') then {value(f, in_sql(c))}" for t, f, c in search.ROUTES) + f" else {other} end"
    return {
        "bm25_topk": f"with {TOKENS}, {bm25_sql(TERMS)} {_TOP}",
        "bm25_unstored": f"with {TOKENS}, {bm25_sql(TERMS)} {_TOP}",
        "bm25_build": f"with {TOKENS}, p as (select doc_id, unnest(terms) term from tok), q as (select doc_id, term, count(*) tf from p group by doc_id, term) select count(*) n_postings, cast(sum(tf) as bigint) n_tokens, count(distinct doc_id) n_docs from q",
        "bm25_topk_lang": f"with {TOKENS}, {bm25_sql(TERMS, language='en')} {_TOP}",
        "bm25_index_stats": f"with {TOKENS} select count(*) n_docs, round(avg(len(terms)), 6) avg_len, (select count(distinct t) from (select unnest(terms) t from tok)) n_terms from tok",
        "bm25_postings": f"with {TOKENS}, p as (select doc_id, unnest(terms) term from tok) select term, count(distinct doc_id) df, count(*) cf from p group by term",
        "bm25_incremental": f"with {TOKENS}, part as (select * from tok where (doc_id % 2 = 0 and doc_id % 3 <> 0) or doc_id % 2 = 1), {bm25_sql(TERMS, 'part')} {_TOP}",
        "token_stats": f"with {TOKENS} select doc_id, cast(len(terms) as bigint) n_tokens, cast(len(list_distinct(terms)) as bigint) n_distinct, md5(array_to_string(terms, ' ')) digest from tok",
        "identifier_split": f"with {RAW} select doc_id, cast(len(raw_terms) as bigint) n, md5(array_to_string(raw_terms, ' ')) digest from exp",
        "strip_comments": f"select page_id, {', '.join(map(stripped, strip))} from pages",
        "knn_cosine": knn_sql(),
        "knn_l2": knn_sql("l2"),
        "knn_dot": knn_sql("dot"),
        "knn_threshold": knn_sql(k=50, where="where distance <= 0.8"),
        "knn_lang_postfilter": knn_sql(k=20, after="where label < 3"),
        "knn_lang_prefilter": knn_sql(k=20, where="where label < 3"),
        "quantize": f"with u as (select vec_id, {_QUANTIZED} e from embeddings) select vec_id, cast(i - 1 as int) i, round(cast(e[i] as double), 6) x from (select vec_id, e, unnest(range(1, len(e) + 1)) i from u)",
        "quantized_knn": f"with v as (select vec_id, label, cast({_QUANTIZED} as double[]) e, (select cast(embedding as double[]) from embeddings where vec_id = 0) q from embeddings), r as (select vec_id, label, {DISTANCE['cosine']} distance from v) select vec_id, label, round(distance, 6) distance from r order by r.distance, vec_id limit 10",
        "all_pairs_cosine_topk": f"with p as (select a.vec_id query_id, b.vec_id, cast(a.embedding as double[]) q, cast(b.embedding as double[]) e from embeddings a, embeddings b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id), r as (select query_id, vec_id, {DISTANCE['cosine']} d from p) select query_id, vec_id, cast(row_number() over (partition by query_id order by d, vec_id) as int) rank, round(d, 6) distance from r qualify rank <= 5",
        "keyword_search": f"select {_CHUNK} file_path, doc_id rowid from documents where text ilike '%tion_the%' and lang = 'en' order by doc_id limit 50",
        "search_by_type": "select 'conv/' || conv_id file_path, cast(turn as int) start_line, conv_id * 1000 + turn rowid from conversations where role = 'assistant' order by 3 limit 20",
        "search_by_type_in_text": f"with k as (select {_CHUNK} file_path, doc_id rowid from documents where text ilike '%thand%' order by doc_id limit 50) select * from k where rowid % 2 = 0 order by rowid limit 20",
        "search_in_file": knn_sql(k=5, where="where label = 4"),
        "search_functions": f"select p_partkey rowid, p_name function_name, cast({_NONE} as bigint) complexity_score from part where p_name ilike '%a%' and p_type ilike '%e%' and '[\"' || replace(p_name, ' ', '\", \"') || '\"]' ilike '%r%' order by {_NONE} nulls first, p_partkey limit 20",
        "search_classes": "select p_partkey rowid, p_brand class_name from part where p_brand ilike '%brand%' and '[\"' || replace(p_type, ' ', '\", \"') || '\"]' ilike '%a%' and '[\"' || p_brand || '\"]' ilike '%1%' order by p_partkey limit 20",
        "search_imports": "select page_id rowid from pages where '[\"' || array_to_string(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), '\", \"') || '\"]' ilike '%/the%' and html ilike '%article%' order by page_id limit 20",
        "general_metadata": "with r as (select p_partkey rowid, case when p_name ilike '%in%' then 1 when p_brand ilike '%in%' then 2 when 'def ' || p_name || ' ' || p_type ilike '%in%' then 3 else 4 end field_rank from part where p_name ilike '%in%' or p_brand ilike '%in%' or 'def ' || p_name || ' ' || p_type ilike '%in%') select rowid, cast(field_rank as bigint) field_rank from r order by field_rank, rowid limit 20",
        "metadata_router_search": f"select p_partkey rowid, p_name function_name from part where p_name ilike '%ring%' order by {_NONE} nulls first, p_partkey limit 20",
        "complexity_range": "select doc_id rowid, n_chars complexity_score from documents where n_chars between 500 and 3000 and lang = 'fr' order by n_chars desc, doc_id limit 30",
        "similar_signature": "select p_partkey rowid, p_name function_name from part where 'def ' || p_name || ' ' || p_type ilike '%red%' or 'def ' || p_name || ' ' || p_type ilike '%blue%' or 'def ' || p_name || ' ' || p_type ilike '%green%' order by p_partkey limit 30",
        "corpus_stats": "select lang language, count(*) n, cast(sum(n_chars) as bigint) chars from documents group by lang",
        "files_by_chunks": "select 'conv/' || conv_id file_path, count(*) n from conversations group by conv_id order by n desc, file_path limit 15",
        "index_status": "select count(*) n_chunks, count(distinct conv_id) n_files, max(turn) last_line, round(sum(octet_length(encode(text))) / 1048576, 2) size_mb from conversations",
        "query_type": f"select item_id, {kinds} kind from (select item_id, {asked}[cast(item_id % {len(ASKED)} as int) + 1] || ' ' || text a from benchmark)",
        "query_expansion": f"with {turns(EXPANDED)}, x as (select rowid, list_filter([q, {more}], lambda e: e is not null)[1:5] x from l) select rowid, cast(unnest(range(len(x))) as int) rank, unnest(x) expanded from x",
        "query_router": f"""with {turns(ROUTED)} select rowid, {routed(lambda f, c: f"'{f}'", "'general'")} field, {routed(lambda f, c: f"regexp_extract(s, '{c}', 1)", "q")} "value" from l""",
    }
