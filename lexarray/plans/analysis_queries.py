"""Queries of fusion, graphs, quality metrics, incremental indexing and chunking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.operators import fusion, graph, incremental, lines, quality, search
from lexarray.plans.search_queries import TERMS, stored_index
from lexarray.plans.sql_parts import DISTANCE, TOKENS
from lexarray.plans.sql_parts import bm25 as bm25_sql
from lexarray.sources.corpus import chunks_from_conversations, chunks_from_documents, table

QUERY = "erblest inenan thorerou hein thanble onwh erblest"
WORDS = "the and thand ing table"


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_from_documents(table(spark, sf, "documents"))


def _legs(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Three rankings of documents: by BM25, by the nearest vectors, by keyword."""
    docs, vectors = _docs(spark, sf), table(spark, sf, "embeddings")
    q = list(vectors.where("vec_id = 0").first()["embedding"])
    a = fusion.ranked(stored_index(spark, sf).search(QUERY, 50), F.desc("score"), "doc")
    b = fusion.ranked(search.knn(vectors, q, 50), "distance", "vec_id").withColumnRenamed("vec_id", "doc")
    c = fusion.ranked(search.keyword_search(docs, "thand"), "rowid").withColumnRenamed("rowid", "doc")
    return [x.select("doc", "rank") for x in (a, b, c)]


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    out = fusion.fuse(_legs(spark, sf)[:2]).orderBy(F.desc("score"), "first_leg", "first_rank").limit(20)
    return out.select(F.col("doc").alias("doc_id"), F.round("score", 8).alias("score"))


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Three legs fused, at most three documents a source, the best twenty."""
    fused = fusion.fuse(_legs(spark, sf))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "source")
    order = (F.desc("score"), "first_leg", "first_rank")
    out = fusion.diverse(docs.join(F.broadcast(fused), "doc"), "source", *order).orderBy(*order).limit(20)
    return out.select(F.col("doc").alias("doc_id"), "source", F.round("score", 8).alias("score"))


def diversity_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks_from_conversations(table(spark, sf, "conversations"))
    return fusion.diverse(rows, "file_path", F.desc(F.length("content")), "rowid", most=2).select("file_path", "rowid")


def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    out = lines.line_chunks(_docs(spark, sf))
    return out.select("file_path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5(F.col("content").cast("binary")).alias("digest"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    """Pages and the names they link to, as dependents and modules."""
    return table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("dependent"), F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"]+)"'), F.lit(1)))).alias("module"))


def import_lines(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace("text", r"(?m)^(\w+) (\w+)", "import $2\nfrom $1 import x")
    rows = table(spark, sf, "documents").select("doc_id", graph.import_lines(text, "python").alias("l"))
    return rows.where("l is not null").select("doc_id", F.size("l").cast("long").alias("n"), F.md5(F.array_join("l", "|").cast("binary")).alias("digest"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """The modules that exist: those of even length as .py, the others as .js files."""
    m = _links(spark, sf).select("module").distinct()
    return m.select(F.when(F.length("module") % 2 == 0, F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".py"))).when(F.length("module") % 3 == 0, F.concat("module", F.lit(".js"))).alias("path")).where("path is not null")


def dependency_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return graph.resolve(_links(spark, sf), _files(spark, sf))


def reverse_deps(spark: SparkSession, sf: str) -> DataFrame:
    return graph.resolve(_links(spark, sf), _files(spark, sf)).groupBy("dep_path").agg(F.countDistinct("dependent").alias("n"))


def impact_set(spark: SparkSession, sf: str) -> DataFrame:
    edges = graph.resolve(_links(spark, sf), _files(spark, sf)).select("dep_path", "dependent").distinct()
    return graph.impact(edges, _files(spark, sf).where("path like '%e%.py'"))


def call_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.array_join(F.sort_array(graph.calls(F.col("html"), dollar=True)), ",").alias("calls"))


def _nodes_edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Regions hold nations, nations hold customers."""
    region, nation, customer = (table(spark, sf, n) for n in ("region", "nation", "customer"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = region.select(key("r", "r_regionkey").alias("id"), F.lit("region").alias("type"), F.col("r_name").alias("name"))
    nodes = nodes.unionByName(nation.select(key("n", "n_nationkey").alias("id"), F.lit("nation").alias("type"), F.col("n_name").alias("name"))).unionByName(customer.select(key("c", "c_custkey").alias("id"), F.lit("customer").alias("type"), F.col("c_name").alias("name")))
    edges = nation.select(key("r", "n_regionkey").alias("source"), key("n", "n_nationkey").alias("target"), F.lit("contains").alias("relationship")).unionByName(customer.select(key("n", "c_nationkey").alias("source"), key("c", "c_custkey").alias("target"), F.lit("contains").alias("relationship")))
    return nodes, edges


def module_graph(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("file_path"), F.col("p_type").alias("function_name"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("class_name"), F.split("p_name", " ").alias("inheritance_chain"))
    nodes, edges = graph.module_graph(parts)
    return edges.groupBy("source", "relationship").agg(F.count("*").alias("n"), F.countDistinct("target").alias("targets"))


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(*_nodes_edges(spark, sf), "r1", "contains").select("id", "type", "name")


def neighbourhood_r2(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbourhood(*_nodes_edges(spark, sf), "n3", 2).select("id", F.col("distance").cast("long").alias("distance"))


def shortest_path(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _nodes_edges(spark, sf)
    goal = edges.where("source like 'n%'").agg(F.min("target")).first()[0]
    nation = edges.where(F.col("target") == goal).first()["source"]
    start = edges.where(F.col("target") == nation).first()["source"]
    path = graph.shortest_path(nodes, edges, start, goal)
    return spark.createDataFrame([(" ".join(path), len(path) - 1)], "path string, distance long")


def inheritance_tree(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    pairs = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("child"), F.lit("world").alias("parent"))).unionByName(region.limit(1).select(F.lit("world").alias("child"), F.lit("r0").alias("parent")))
    return graph.ancestors(pairs).select("root", "ancestor", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))


def context_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks_from_conversations(table(spark, sf, "conversations"))
    return graph.context_window(rows, "conv/1", 1001).select("rowid", F.col("place").cast("long").alias("place"))


def completeness_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", quality.completeness(F.when(F.col("page_id") % 2 == 0, "function_definition").otherwise("code_block"), F.col("html")).alias("score"))


def crossfile_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    score = quality.cross_file(F.lit(WORDS), F.split("text", "\n"), F.split("text", " "), F.concat("source", F.lit("/table.py")))
    return docs.select("doc_id", F.round(score, 6).alias("score"))


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries are sources; their documents ranked by length; items are the documents, relevant if labelled good."""
    from pyspark.sql import Window

    docs = table(spark, sf, "documents")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = docs.select(F.col("source").alias("query_id"), rank.alias("rank"), F.array(F.col("doc_id").cast("string")).alias("items"))
    qrels = table(spark, sf, "labels").where("quality = 1").join(docs.select("doc_id", "source"), "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("item"))
    return ranked, qrels


def precision_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return quality.precision_recall(*_judged(spark, sf), 10).select("query_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def mean_average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return quality.average_precision(*_judged(spark, sf)).agg(F.round(F.avg("ap"), 6).alias("map"), F.count("*").alias("n_queries"))


def ndcg(spark: SparkSession, sf: str) -> DataFrame:
    ranked, qrels = _judged(spark, sf)
    flagged = ranked.select("query_id", "rank", F.col("items")[0].alias("item")).join(qrels.withColumn("score", F.lit(1.0)), ["query_id", "item"], "left").fillna(0.0, ["score"])
    return quality.ndcg(flagged, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def method_compare(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    by = lambda lang: docs.where(F.col("lang") == lang).select(F.explode(F.create_map(F.lit("avg_chars"), F.avg("n_chars"), F.lit("avg_lines"), F.avg(F.size(F.split("text", "\n"))))).alias("metric", "value"))
    return quality.compare(by("fr"), by("en")).select("metric", F.round("improvement", 6).alias("improvement"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    means = events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))
    return means.join(quality.percentiles(events, "event_type", "value", 95, 99), "event_type").select("event_type", "mean", "p95", "p99")


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Files as they were recorded and as they are: events of the first part and of the second, by user."""
    events = table(spark, sf, "events")
    old = events.where("event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("last_indexed"), F.max_by("event_type", "event_id").alias("file_hash"))
    new = events.where("event_id % 2 = 1 and user_id % 5 > 0").groupBy("user_id").agg(F.max("event_id").alias("modified"), F.max_by("event_type", "event_id").alias("file_hash"))
    key = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path")
    return old.select(key, "last_indexed", "file_hash"), new.select(key, "modified", "file_hash")


def detect_changes(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.detect_changes(*_states(spark, sf))


def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents not divisible by 4 are indexed; of the others new ones come, every 5th goes, every 7th is read again."""
    docs = _docs(spark, sf)
    index = docs.where("rowid % 4 > 0").withColumn("version", F.lit(0))
    status = F.when(F.col("rowid") % 5 == 0, "deleted").when(F.col("rowid") % 7 == 0, "modified").when(F.col("rowid") % 4 == 0, "new")
    changes = docs.select(F.col("file_path").alias("path"), status.alias("status")).where("status is not null")
    return incremental.apply_changes(index, changes, docs.withColumn("version", F.lit(1))).select("file_path", "rowid", "version")


def legacy_migration(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    legacy = rows.select("vec_id", F.when(F.col("vec_id") % 10 == 0, None).when(F.col("vec_id") % 10 == 1, "not json").otherwise(F.to_json("embedding")).alias("embedding"))
    return incremental.migrate(legacy).select("vec_id", F.size("embedding").cast("long").alias("dims"))


def schema_evolution(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.evolve(table(spark, sf, "labels"), {"quality": "int", "docstring": "string", "complexity_score": "int"})


_FUNCTIONS = (
    rrf_fusion, hybrid_search, diversity_cap, line_chunks, import_lines, dependency_resolve, reverse_deps, impact_set, call_extract, module_graph, neighbours, neighbourhood_r2, shortest_path,
    inheritance_tree, context_window, completeness_score, crossfile_score, precision_recall_at_k, mean_average_precision, ndcg, method_compare, latency_percentiles,
    detect_changes, apply_changes, legacy_migration, schema_evolution,
)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


_VEC = f"ev as (select vec_id, label, cast(embedding as double[]) e, (select cast(embedding as double[]) from embeddings where vec_id = 0) q from embeddings), near as (select vec_id doc_id, row_number() over (order by {DISTANCE['cosine']}, vec_id) rank from ev qualify rank <= 50)"
_LEGS = f"{TOKENS}, {bm25_sql(TERMS, n=50)}, {_VEC}, kw as (select doc_id, row_number() over (order by doc_id) rank from documents where text ilike '%thand%' qualify rank <= 50), legs as (select doc_id, row_number() over (order by score desc, doc_id) rank, 0 leg from bm union all select doc_id, rank, 1 from near"
_FUSED = "fused as (select doc_id, sum(1.0 / (60 + rank)) score, min(leg * 1000 + rank) first from legs group by doc_id)"
_LINKS = "links as (select distinct cast(page_id as varchar) dependent, unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)) module from pages)"
_FILES = f"{_LINKS}, files as (select distinct case when len(module) % 2 = 0 then replace(module, '.', '/') || '.py' when len(module) % 3 = 0 then module || '.js' end path from links)"
_DEPS = f"{_FILES}, tried as (select dependent, module, unnest([replace(module, '.', '/') || '.py', module || '.py', module || '.js', module || '.ts', module || '.go']) dep_path, unnest([0, 1, 2, 3, 4]) p from links where module not like '.%'), deps as (select dependent, module, arg_min(dep_path, p) dep_path from tried join files on files.path = dep_path group by dependent, module)"
_EDGES = "edges as (select 'r' || n_regionkey s, 'n' || n_nationkey t from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer)"
_QW = "[" + ", ".join(f"'{w}'" for w in WORDS.split()) + "]"
_JUDGED = "j as (select source query_id, row_number() over (partition by source order by n_chars desc, doc_id) rank, coalesce(quality, 0) = 1 hit from documents left join (select distinct doc_id, quality from labels where quality = 1) using (doc_id)), rel as (select query_id, count(*) filter (hit) relevant from j group by query_id)"


def oracle_sql() -> dict[str, str]:
    state = "old as (select 'u' || user_id path, max(event_id) t0, arg_max(event_type, event_id) h0 from events where event_id % 2 = 0 group by user_id), cur as (select 'u' || user_id path, max(event_id) t1, arg_max(event_type, event_id) h1 from events where event_id % 2 = 1 and user_id % 5 > 0 group by user_id)"
    low = lambda p: f"list_sort(list(value))[cast(floor({p} / 100.0 * (count(*) - 1)) as int) + 1]"
    return {
        "rrf_fusion": f"with {_LEGS}), {_FUSED} select doc_id, round(score, 8) score from fused order by fused.score desc, first limit 20",
        "hybrid_search": f"with {_LEGS} union all select doc_id, rank, 2 from kw), {_FUSED}, d as (select doc_id, source, score, first, row_number() over (partition by source order by score desc, first) k from fused join documents using (doc_id)) select doc_id, source, round(score, 8) score from d where k <= 3 order by d.score desc, first limit 20",
        "diversity_cap": "select 'conv/' || conv_id file_path, conv_id * 1000 + turn rowid from conversations qualify row_number() over (partition by conv_id order by len(text) desc, conv_id * 1000 + turn) <= 2",
        "line_chunks": "with l as (select source || '/' || doc_id || '.txt' file_path, string_split(text, chr(10)) l from documents), w as (select file_path, l, unnest(range(0, len(l), 12)) a from l), c as (select file_path, array_to_string(l[a + 1:a + 15], chr(10)) content, a + 1 start_line, least(a + 15, len(l)) end_line from w) select file_path, cast(start_line as bigint) start_line, cast(end_line as bigint) end_line, md5(content) digest from c where regexp_matches(content, '[^\\s]')",
        "import_lines": "with t as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^(\\w+) (\\w+)', 'import \\2' || chr(10) || 'from \\1 import x', 'g'), chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: starts_with(s, 'import ') or starts_with(s, 'from ')) l from documents) select doc_id, cast(len(l) as bigint) n, md5(array_to_string(l, '|')) digest from t where len(l) > 0",
        "dependency_resolve": f"with {_DEPS} select * from deps",
        "reverse_deps": f"with {_DEPS} select dep_path, count(distinct dependent) n from deps group by dep_path",
        "impact_set": f"with {_DEPS}, ch as (select path from files where path like '%e%.py') select path from ch union select dependent from deps join ch on dep_path = path",
        "call_extract": "select page_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(html, '\\b([a-zA-Z_$][\\w$]*)\\s*\\(', 1), lambda x: len(x) > 2 and x not in ('if', 'while', 'for', 'try', 'catch', 'with', 'super', 'print', 'len', 'str', 'int', 'float')))), ',') calls from pages",
        "module_graph": "with e as (select 'file:' || p_brand source, 'function:' || p_brand || ':' || p_type target, 'contains' relationship from part union all select 'file:' || p_brand, 'class:' || p_brand || ':' || p_name, 'contains' from part where p_size > 25 union all select 'class:' || p_brand || ':' || p_name, t, 'inherits' from (select p_brand, p_name, unnest(string_split(p_name, ' ')) name from part where p_size > 25) join (select p_name name, min('class:' || p_brand || ':' || p_name) t from part where p_size > 25 group by p_name) using (name)) select source, relationship, count(*) n, count(distinct target) targets from e group by source, relationship",
        "neighbours": "select 'n' || n_nationkey id, 'nation' type, n_name \"name\" from nation where n_regionkey = 1",
        "neighbourhood_r2": f"with recursive {_EDGES}, b as (select s, t from edges union select t, s from edges), r(id, d) as (select 'n3', 0 union select b.t, d + 1 from r join b on b.s = r.id where d < 2) select id, cast(min(d) as bigint) distance from r group by id",
        "shortest_path": "with g as (select min('c' || c_custkey) c from customer) select 'r' || n_regionkey || ' n' || n_nationkey || ' ' || c path, cast(2 as bigint) distance from g join customer on 'c' || c_custkey = c join nation on c_nationkey = n_nationkey",
        "inheritance_tree": "with recursive p as (select 'n' || n_nationkey c, 'r' || n_regionkey p from nation union all select 'r' || r_regionkey, 'world' from region union all select 'world', 'r0'), a(root, ancestor, depth, path) as (select c, p, 1, [c, p] from p union all select root, p.p, depth + 1, list_append(path, p.p) from a join p on p.c = a.ancestor where not list_contains(path, p.p)) select root, ancestor, cast(depth as bigint) depth, array_to_string(path, '>') path from a",
        "context_window": "with c as (select conv_id * 1000 + turn rowid, row_number() over (order by conv_id * 1000 + turn) place from conversations where conv_id = 1) select c.rowid, c.place from c, (select place p from c where rowid = 1001) where abs(c.place - p) <= 2 and c.place <> p",
        "completeness_score": "with b as (select page_id, page_id % 2 = 0 f, len(regexp_extract_all(html, '[{(\\[]')) = len(regexp_extract_all(html, '[})\\]]')) ok, (contains(html, 'def ') or contains(html, 'function ') or contains(html, 'fn ')) and (contains(html, '{') or contains(html, ':')) head from pages) select page_id, cast(case when f then case when head then 1 else 0.5 end else case when ok then 1 else 0.7 end end as double) score from b",
        "crossfile_score": f"select doc_id, round(cast(least(1.0, 0.2 * len(list_filter(string_split(text, chr(10)), lambda x: len(list_intersect({_QW}, regexp_split_to_array(lower(x), '\\s+'))) > 0)) + 0.15 * len(list_filter(string_split(text, ' '), lambda d: len(list_filter({_QW}, lambda w: contains(lower(d), w))) > 0)) + 0.3) as double), 6) score from documents",
        "precision_recall_at_k": f"with {_JUDGED} select query_id, round(count(*) filter (hit) / count(*), 6) \"precision\", round(coalesce(count(*) filter (hit) / nullif(any_value(relevant), 0), 0), 6) recall from j join rel using (query_id) where rank <= 10 group by query_id",
        "mean_average_precision": f"with {_JUDGED}, p as (select query_id, hit, sum(cast(hit as int)) over (partition by query_id order by rank) / rank x from j), ap as (select query_id, sum(x) / any_value(relevant) ap from p join rel using (query_id) where hit group by query_id) select round(avg(ap), 6) map, count(*) n_queries from ap",
        "ndcg": f"with {_JUDGED}, t as (select query_id, rank, cast(hit as double) s, row_number() over (partition by query_id order by hit desc, rank) i from j where rank <= 10), g as (select query_id, sum(case when rank = 1 then s else s / log2(rank) end) d, sum(case when i = 1 then s else s / log2(i) end) b from t group by query_id) select query_id, round(case when b > 0 then d / b else 0 end, 6) ndcg from g",
        "method_compare": "with m as (select lang, avg(n_chars) a, avg(len(string_split(text, chr(10)))) b from documents group by lang), f as (select * from m where lang = 'fr'), e as (select * from m where lang = 'en') select 'avg_chars' metric, round((f.a - e.a) / e.a * 100, 6) improvement from f, e union all select 'avg_lines', round((f.b - e.b) / e.b * 100, 6) from f, e",
        "latency_percentiles": f"select event_type, round(avg(value), 6) mean, {low(95)} p95, {low(99)} p99 from events group by event_type",
        "detect_changes": f"with {state}, c as (select path, case when t1 is null then 'deleted' when t0 is null then 'new' when t1 > t0 and h0 is distinct from h1 then 'modified' end status from old full join cur using (path)) select * from c where status is not null",
        "apply_changes": "with d as (select source || '/' || doc_id || '.txt' file_path, doc_id rowid, case when doc_id % 5 = 0 then 'deleted' when doc_id % 7 = 0 then 'modified' when doc_id % 4 = 0 then 'new' else 'same' end s from documents) select file_path, rowid, case when s = 'same' then 0 else 1 end \"version\" from d where s in ('modified', 'new') or (s = 'same' and rowid % 4 > 0)",
        "legacy_migration": "select vec_id, cast(len(embedding) as bigint) dims from embeddings where vec_id % 10 > 1",
        "schema_evolution": "select *, cast(null as varchar) docstring, cast(null as int) complexity_score from labels",
    }
