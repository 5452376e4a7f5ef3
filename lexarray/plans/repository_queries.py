"""Queries of repository analysis, evaluation and lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarray.functions import vector
from lexarray.operators import evaluation, graph, incremental, quality, repository
from lexarray.sources import files
from lexarray.sources.corpus import chunks_from_parts, table

GOAL = "src/economy/ring_1.py"
WORDS = "red ring import import x blue_gear"


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return chunks_from_parts(table(spark, sf, "part"))


def module_imports(spark: SparkSession, sf: str) -> DataFrame:
    _, edges = repository.module_graph(_parts(spark, sf))
    return edges.where("relationship = 'imports'").groupBy("source", "target").agg(F.count("*").alias("n"))


def file_distance(spark: SparkSession, sf: str) -> DataFrame:
    """Steps from each node to the first file whose name holds gear."""
    nodes, edges = repository.module_graph(_parts(spark, sf))
    goal = edges.where("relationship = 'imports' and target like '%gear%'").agg(F.min("target")).first()[0]
    return repository.distances_to(edges, goal).select("id", F.col("distance").cast("long").alias("distance"))


def related_code(spark: SparkSession, sf: str) -> DataFrame:
    return repository.related(_parts(spark, sf)).select("rowid", F.col("place").cast("long").alias("place"), "related", "source")


def context_related(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf)
    path = rows.where("rowid = 0").first()["file_path"]
    return repository.context_chunks(rows, path, 0).select("part", F.col("place").cast("long").alias("place"), "rowid")


def contextual_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf).withColumn("file_path", F.concat(F.when(F.col("rowid") % 3 == 0, "src/API/").when(F.col("rowid") % 3 == 1, "src/other/").otherwise(""), repository.base_name(F.col("file_path"))))
    nodes, edges = repository.module_graph(rows)
    goal = rows.where("rowid = 0").first()["file_path"]
    return repository.reranked(rows, WORDS, nodes, edges, goal).select("rowid", F.round("context_score", 6).alias("score"))


def knowledge_graph(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = repository.knowledge_graph(_parts(spark, sf))
    out = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_files"))
    return nodes.join(out, "id", "left").select("id", "type", "name", "file_path", F.coalesce("n_files", F.lit(0)).alias("n_files"))


def entity_query(spark: SparkSession, sf: str) -> DataFrame:
    return repository.entities(repository.knowledge_graph(_parts(spark, sf))[0], "function", "RED_").select("id", "name")


def entity_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return repository.relationships(repository.knowledge_graph(_parts(spark, sf))[1], "class:red", "contains").select("source", "target")


def graph_totals(spark: SparkSession, sf: str) -> DataFrame:
    return repository.totals(*repository.module_graph(_parts(spark, sf)))


def file_summary(spark: SparkSession, sf: str) -> DataFrame:
    joined = [F.array_join(c, ",").alias(c) for c in ("imports", "dependencies", "functions", "classes")]
    return repository.file_summaries(_parts(spark, sf)).select("file_path", *joined)


def import_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Import lines of several forms, made of the words of part names."""
    parts = table(spark, sf, "part").select("p_partkey", F.split("p_name", " ").alias("w"), (F.col("p_partkey") % 5).alias("k"))
    a, b = F.col("w")[0], F.col("w")[1]
    line = F.when(F.col("k") == 0, F.concat(F.lit("import "), a, F.lit(".sub as "), b)).when(F.col("k") == 1, F.concat(F.lit("from "), a, F.lit("."), b, F.lit(" import x"))).when(F.col("k") == 2, F.concat(F.lit("import x from '../"), a, F.lit("/"), b, F.lit(".js'")))
    line = line.when(F.col("k") == 3, F.concat(F.lit("const y = require('"), b, F.lit("')"))).otherwise(F.concat(F.lit("use "), a))
    language = F.when(F.col("k") < 2, "python").when(F.col("k") < 4, "javascript").otherwise("rust")
    rows = parts.select("p_partkey", line.alias("line"), language.alias("language"))
    return rows.select("p_partkey", repository.import_target(F.col("line"), F.col("language")).alias("target"), F.array_join(repository.dependencies(F.array("line"), F.col("language")), ",").alias("dependency"))


def import_extract(spark: SparkSession, sf: str) -> DataFrame:
    text = F.regexp_replace("text", r"(?m)^(\w+) (\w+)", "import $2\nfrom $1 import x")
    rows = table(spark, sf, "documents").select("doc_id", graph.imports(text, "python").alias("m"))
    return rows.where("size(m) > 0").select("doc_id", F.size("m").cast("long").alias("n"), F.md5(F.array_join(F.sort_array("m"), ",").cast("binary")).alias("digest"))


def relevance_score(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("text", r"\s+")
    docs = table(spark, sf, "documents")
    score = quality.relevance(F.lit("the thand table anthor"), F.col("text"), F.concat_ws("_", F.get(words, 1), F.get(words, 2)), F.get(words, 3), F.col("text"))
    return docs.select("doc_id", F.round(score, 6).alias("score"))


def chunk_items(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("rowid", F.array_join(quality.items(F.col("function_name"), F.col("class_name"), F.col("file_path")), ",").alias("items"))


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Queries are brands; their parts ranked by price; wanted are the functions of large ones and each brand's rings' files."""
    parts = table(spark, sf, "part")
    rows = _parts(spark, sf).join(parts.select(F.col("p_partkey").alias("rowid"), F.col("p_brand").alias("query_id"), "p_retailprice"), "rowid")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("p_retailprice"), "rowid"))
    ranked = rows.select("query_id", rank.alias("rank"), quality.items(F.col("function_name"), F.col("class_name"), F.col("file_path")).alias("items"))
    wanted = parts.where("p_size = 30").select(F.col("p_brand").alias("query_id"), F.concat(F.lit("function:"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("item"))
    rings = parts.where("p_name like '%ring'").select(F.col("p_brand").alias("query_id"), F.concat(F.lit("file:ring_"), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit(".py")).alias("item"))
    return ranked, wanted.unionByName(rings).distinct()


def graded_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return quality.ndcg(evaluation.graded(*_judged(spark, sf)), 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


def evaluate_method(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluation.aggregated(evaluation.evaluated(*_judged(spark, sf)))
    return out.select("metric", *[F.round(c, 6).alias(c) for c in ("avg", "min", "max")])


def migration_check(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    legacy = rows.select("vec_id", F.when(F.col("vec_id") % 10 > 0, F.to_json("embedding")).alias("embedding"))
    return incremental.verify_migration(legacy, incremental.migrate(legacy)).select("total", "with_vector", "migrated", "complete")


def pairwise_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Each vector with the next by id."""
    rows = table(spark, sf, "embeddings")
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(after, "vec_id").select("vec_id", F.round(vector.cosine_similarity(F.col("embedding"), F.col("other")), 4).alias("similarity"))


def function_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return repository.by_function_name(_parts(spark, sf), "red_ring").select("rowid", "file_path")


def file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks of the file that holds the first part."""
    rows = _parts(spark, sf)
    return repository.of_file(rows, rows.where("rowid = 1").first()["file_path"]).select("rowid", "semantic_type")


ENDS = ("py", "JS", "tsx", "rs", "HTM", "html", "cc", "yml", "md", "h")


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths with endings of all kinds, some in folders that are left out."""
    key = F.col("p_partkey")
    folder = F.when(key % 7 == 0, "/x/node_modules/a/").when(key % 7 == 1, "/x/build/").when(key % 7 == 2, "venv/lib/").otherwise("/x/src/")
    end = F.element_at(F.array(*[F.lit(e) for e in ENDS]), (key % len(ENDS) + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat(folder, F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), end).alias("path"))


def file_languages(spark: SparkSession, sf: str) -> DataFrame:
    maps = {"scanned": files.LANGUAGES, "detected": files.DETECTED, "extracted": files.EXTRACTED, "updated": files.UPDATED}
    return _paths(spark, sf).select("p_partkey", *[files.language_of(F.col("path"), known).alias(name) for name, known in maps.items()])


def glob_excludes(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return _paths(spark, sf).select("p_partkey", files.excluded(path, [*files.EXCLUDED, "*red_*.p?"]).alias("by_index"), files.excluded(path, files.UPDATE_EXCLUDED, absolute=True).alias("by_update"))


_FUNCTIONS = (
    module_imports, file_distance, related_code, context_related, contextual_rerank, knowledge_graph, entity_query, entity_relationships, graph_totals, file_summary, import_targets, import_extract, relevance_score,
    chunk_items, graded_ndcg, evaluate_method, migration_check, pairwise_cosine, function_lookup, file_scan, file_languages, glob_excludes,
)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


_PC = """pw as (select *, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) b from part),
pc as (select p_partkey rowid, 'src/' || lower(p_type) || '/' || b || '_' || replace(p_brand, 'Brand#', '') || '.py' file_path, b || '_' || replace(p_brand, 'Brand#', '') || '.py' file_name, case when p_size <= 30 then a || '_' || b end function_name,
  case when p_size > 30 then case when p_size % 2 = 0 then b else a end end class_name, case when p_size > 40 then a end base, [a, lower(p_type)] deps, ['import ' || b || '.x', 'from ' || b || '_1 import y'] imports, 'def ' || a || '_' || b || '(x):' || chr(10) || '    return red_' || b || '(x)' content, a, b, p_brand, p_retailprice, p_size from pw)"""


def _graph(path: str = "file_path") -> str:
    return f"""fs as (select {path} file_path, file_name, min(rowid) ord from pc group by all),
ln as (select rowid, {path} own, unnest([0, 1]) place, unnest([b, b || '_1']) module from pc),
ff as (select module, arg_min(file_path, ord) target from (select distinct module from ln) join fs on contains(file_name, module) group by module),
im as (select rowid, own, place, module, target from ln join ff using (module)),
cl as (select class_name "name", min('class:' || {path} || ':' || class_name) id from pc where class_name is not null group by class_name),
eg as (select 'file:' || {path} s, 'function:' || {path} || ':' || function_name t, 'contains' r from pc where function_name is not null union all select 'file:' || {path}, 'class:' || {path} || ':' || class_name, 'contains' from pc where class_name is not null
  union all select 'class:' || {path} || ':' || class_name, id, 'inherits' from pc join cl on base = cl.name where class_name is not null union all select 'file:' || own, 'file:' || target, 'imports' from im)"""


_REL = """fi as (select file_path target, rowid related, row_number() over (partition by file_path order by rowid) nth from pc),
ca as (select class_name "name", file_path, rowid related from pc where class_name is not null), ho as (select "name", arg_min(file_path, related) file_path from ca group by "name"),
cn as (select "name", related, row_number() over (partition by "name" order by related) nth from ca join ho using ("name", file_path)), fu as (select function_name "name", min(rowid) related from pc where function_name is not null group by function_name),
al as (select im.rowid, related, 0 leg, place x, '' y, nth z from im join fi using (target) where nth <= 3 union all select rowid, related, 1, 0, '', nth from pc join cn on base = cn.name where class_name is not null and nth <= 2
  union all select rowid, related, 2, 0, "name", 0 from (select rowid, unnest(list_distinct([a || '_' || b, 'red_' || b])) "name" from pc) join fu using ("name")),
re as (select *, row_number() over (partition by rowid order by leg, x, y, z) place from (select * from al where rowid <> related qualify row_number() over (partition by rowid, related order by leg, x, y, z) = 1))"""
_KG = """kn as (select distinct 'file:' || file_path id, 'file' type, file_name "name", file_path from pc union all select 'function:' || function_name, 'function', function_name, arg_max(file_path, rowid) from pc where function_name is not null group by function_name
  union all select 'class:' || class_name, 'class', class_name, arg_max(file_path, rowid) from pc where class_name is not null group by class_name),
ke as (select distinct 'file:' || file_path s, 'function:' || function_name t from pc where function_name is not null union select 'file:' || file_path, 'class:' || class_name from pc where class_name is not null)"""
_JUDGED = """rk as (select p_brand query_id, row_number() over (partition by p_brand order by p_retailprice desc, rowid) rank, list_filter(['function:' || function_name, 'class:' || class_name, 'file:' || file_name], lambda v: v is not null) items from pc),
ql as (select distinct p_brand query_id, 'function:' || a || '_' || b item from pc where p_size = 30 union select p_brand, 'file:ring_' || replace(p_brand, 'Brand#', '') || '.py' from pc where b = 'ring'),
wt as (select query_id, list(item) w from ql group by query_id),
fl as (select query_id, rank, coalesce(w, []) w, unnest(items) item, unnest(range(len(items))) i from rk left join wt using (query_id)),
gr as (select query_id, row_number() over (partition by query_id order by rank, i) rank, case when list_contains(w, item) then 1.0 when len(list_filter(w, lambda v: contains(regexp_replace(lower(v), '[_-]', '', 'g'), regexp_replace(lower(item), '[_-]', '', 'g')) or contains(regexp_replace(lower(item), '[_-]', '', 'g'), regexp_replace(lower(v), '[_-]', '', 'g')))) > 0 then 0.5 else 0.0 end s from fl)"""


def _ndcg(k: int) -> str:
    return f"""nd{k} as (select query_id, case when sum(case when i = 1 then s else s / log2(i) end) > 0 then sum(case when rank = 1 then s else s / log2(rank) end) / sum(case when i = 1 then s else s / log2(i) end) else 0 end v
  from (select *, row_number() over (partition by query_id order by s desc, rank) i from gr where rank <= {k}) group by query_id)"""


def _pr(k: int) -> str:
    return f"""pr{k} as (select query_id, coalesce(h, 0) / n p, case when len(w) > 0 then coalesce(h, 0) / len(w) else 0 end r from (select query_id, count(*) n from rk where rank <= {k} group by query_id) left join wt using (query_id)
  left join (select query_id, count(distinct item) h from (select query_id, unnest(items) item from rk where rank <= {k}) join ql using (query_id, item) group by query_id) using (query_id))"""


def oracle_sql() -> dict[str, str]:
    low = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+')"
    query = "['the', 'thand', 'table', 'anthor']"
    n = "greatest(4, cast(floor(least(len(w), len(p)) * 0.7) as int))"
    inside = "contains(lower({c}), w) or (len({c}) > 0 and contains(w, lower({c})))"
    ends = "[" + ", ".join(f"'{e}'" for e in ENDS) + "]"
    paths = f"pt as (select p_partkey, case p_partkey % 7 when 0 then '/x/node_modules/a/' when 1 then '/x/build/' when 2 then 'venv/lib/' else '/x/src/' end || replace(p_name, ' ', '_') || '.' || {ends}[cast(p_partkey % {len(ENDS)} as int) + 1] path from part)"
    named = lambda known: "case regexp_extract(lower(path), '\\.([^./]+)$', 1) " + " ".join(f"when '{e}' then '{lang}'" for lang, own in known.items() for e in own.split()) + " else 'text' end"
    left_out = lambda globs, also: " or ".join(f"{p} glob '{g}'" for g in globs for p in ["path"] + ["ltrim(path, '/')"] * also)
    path = "case rowid % 3 when 0 then 'src/API/' when 1 then 'src/other/' else '' end || file_name"
    reach = "rc as (select t id, 0 d from (select {goal} t) union select s, d + 1 from rc join eg on eg.t = rc.id where d < 6)"
    metric = {f"{m}_at_{k}": f"select v from (select query_id, {c} v from {t}{k})" for k in (5, 10) for m, t, c in (("precision", "pr", "p"), ("recall", "pr", "r"), ("ndcg", "nd", "v"))}
    metric["mean_average_precision"] = "select coalesce(v, 0) v from (select distinct query_id from rk) left join ap using (query_id)"
    rows = " union all ".join(f"select '{m}' metric, v from ({q})" for m, q in metric.items())
    return {
        "module_imports": f"with {_PC}, {_graph()} select s source, t target, count(*) n from eg where r = 'imports' group by s, t",
        "file_distance": f"with recursive {_PC}, {_graph()}, {reach.format(goal=chr(40) + 'select min(t) from eg where r = ' + chr(39) + 'imports' + chr(39) + ' and t like ' + chr(39) + '%gear%' + chr(39) + chr(41))} select id, cast(min(d) as bigint) distance from rc group by id",
        "related_code": f"with {_PC}, {_graph()}, {_REL} select rowid, place, related, ['import', 'inheritance', 'call'][leg + 1] source from re where place <= 10",
        "context_related": f"with {_PC}, {_graph()}, {_REL}, bs as (select rowid, row_number() over (order by rowid) place from pc where file_path = (select file_path from pc where rowid = 0)) select 'beside' part, place, rowid from bs where place between 2 and 3 union all select 'related', place, related from re where rowid = 0 and place <= 5",
        "contextual_rerank": f"with recursive {_PC}, {_graph(chr(40) + path + chr(41))}, {reach.format(goal='select ' + chr(39) + 'file:' + chr(39) + ' || ' + path + ' from pc where rowid = 0').replace('(select select', '(select').replace(' t) union', ' ) g(t) union')}, ds as (select id, min(d) d from rc group by id), sc as (select rowid, coalesce(0.3 / (d + 1), 0) near, least(1.0, list_sum(list_transform(imports, lambda v: len(list_intersect(['red', 'ring', 'import', 'x', 'blue_gear'], regexp_split_to_array(v, '\\s+'))) / 5.0))) i, len(list_filter(['red', 'ring', 'import', 'x', 'blue_gear'], lambda w: contains(lower(content), w))) / 5.0 c, case when rowid % 3 = 0 then 0.5 else 0 end k from pc left join ds on id = 'file:' || ({path})) select rowid, round(cast(least(1.0, near + 0.2 * i + 0.2 * c + 0.3 * k) as double), 6) score from sc",
        "knowledge_graph": f"with {_PC}, {_KG} select id, type, \"name\", file_path, coalesce(n_files, 0) n_files from kn left join (select t id, count(*) n_files from ke group by t) using (id)",
        "entity_query": f"with {_PC}, {_KG} select id, \"name\" from kn where type = 'function' and contains(lower(\"name\"), 'red_')",
        "entity_relationships": f"with {_PC}, {_KG} select s source, t target from ke where s = 'class:red' or t = 'class:red'",
        "graph_totals": f"with {_PC}, {_graph()}, no as (select distinct 'file' kind, file_path id from pc union select 'function', file_path || ':' || function_name from pc where function_name is not null union select 'class', file_path || ':' || class_name from pc where class_name is not null) select 'node' part, kind, count(*) n from no group by kind union all select 'edge', r, count(*) from eg group by r",
        "file_summary": f"with {_PC}, su as (select file_path, list_sort(list_distinct(flatten(list(imports)))) i, list_sort(list_distinct(flatten(list(deps)))) d, list_sort(list_distinct(list(function_name) filter (function_name is not null))) f, list_sort(list_distinct(list(class_name) filter (class_name is not null))) c from pc group by file_path) select file_path, array_to_string(i, ',') imports, array_to_string(d, ',') dependencies, coalesce(array_to_string(f, ','), '') functions, coalesce(array_to_string(c, ','), '') classes from su",
        "import_targets": "with w as (select p_partkey, p_partkey % 5 k, split_part(p_name, ' ', 1) a, split_part(p_name, ' ', 2) b from part) select p_partkey, case when k < 2 then a when k = 2 then b end target, case when k < 2 then a when k = 2 then '../' || a || '/' || b || '.js' when k = 3 then b end dependency from w",
        "import_extract": "with t as (select doc_id, regexp_replace(text, '(?m)^(\\w+) (\\w+)', 'import \\2' || chr(10) || 'from \\1 import x', 'g') x from documents), m as (select doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(x, '(?m)^\\s*import\\s+([A-Za-z_][\\w.]*)', 1), regexp_extract_all(x, '(?m)^\\s*from\\s+([A-Za-z_][\\w.]*)\\s+import', 1)))) m from t) select doc_id, cast(len(m) as bigint) n, md5(array_to_string(m, ',')) digest from m where len(m) > 0",
        "relevance_score": f"with d as (select doc_id, text, regexp_split_to_array(text, '\\s+') s, text doc from documents), e as (select *, case when len(s) > 2 then s[2] || '_' || s[3] when len(s) > 1 then s[2] else '' end fn, coalesce(s[4], '') cls from d), f as (select *, regexp_extract_all(lower(fn), '[a-z]+') parts from e), g as (select doc_id, len(list_intersect({query}, list_distinct({low.format(c='text')}))) / 4.0 o, list_sum(list_transform({query}, lambda w: case when {inside.format(c='fn')} then 0.4 when len(list_filter(parts, lambda p: len(w) > 4 and len(p) > 4 and substr(w, 1, {n}) = substr(p, 1, {n}))) > 0 then 0.2 else 0.0 end)) b, case when len(list_filter({query}, lambda w: {inside.format(c='cls')})) > 0 then 0.3 else 0 end c, case when len(list_filter({query}, lambda w: contains(lower(doc), w))) > 0 then 0.2 else 0 end x from f) select doc_id, round(cast(least(1.0, o + b + c + x) as double), 6) score from g",
        "chunk_items": f"with {_PC} select rowid, concat_ws(',', 'function:' || function_name, 'class:' || class_name, 'file:' || file_name) items from pc",
        "graded_ndcg": f"with {_PC}, {_JUDGED}, {_ndcg(10)} select query_id, round(v, 6) ndcg from nd10",
        "evaluate_method": f"with {_PC}, {_JUDGED}, {_ndcg(5)}, {_ndcg(10)}, {_pr(5)}, {_pr(10)}, hi as (select query_id, rank, len(list_intersect(items, w)) > 0 hit, len(w) n from rk join wt using (query_id)), ap as (select query_id, sum(x) / any_value(n) v from (select *, sum(cast(hit as int)) over (partition by query_id order by rank) / rank x from hi) where hit group by query_id), mt as ({rows}) select metric, round(avg(v), 6) \"avg\", round(cast(min(v) as double), 6) \"min\", round(cast(max(v) as double), 6) \"max\" from mt group by metric",
        "migration_check": "select count(*) total, count(*) filter (vec_id % 10 > 0) with_vector, count(*) filter (vec_id % 10 > 0) migrated, true complete from embeddings",
        "pairwise_cosine": "with v as (select vec_id, cast(embedding as double[]) e from embeddings) select x.vec_id, round(list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))), 4) similarity from v x join v y on y.vec_id = x.vec_id + 1",
        "function_lookup": f"with {_PC} select rowid, file_path from pc where function_name = 'red_ring' order by rowid limit 5",
        "file_scan": f"with {_PC} select rowid, case when function_name is not null then 'function_definition' else 'class_definition' end semantic_type from pc where file_path = (select file_path from pc where rowid = 1)",
        "file_languages": f"with {paths} select p_partkey, {named(files.LANGUAGES)} scanned, {named(files.DETECTED)} detected, {named(files.EXTRACTED)} extracted, {named(files.UPDATED)} updated from pt",
        "glob_excludes": f"with {paths} select p_partkey, {left_out([*files.EXCLUDED, '*red_*.p?'], True)} by_index, {left_out([g.replace('**', '*') for g in files.UPDATE_EXCLUDED], False)} by_update from pt",
    }
