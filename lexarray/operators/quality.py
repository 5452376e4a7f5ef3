"""Relevance scores, reranking and retrieval metrics as expressions and window aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarray.functions.text import word_set

#: Directories whose files form clusters.
CLUSTERS = "auth database api models services utils components".split()


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def root_match(a: Column, b: Column) -> Column:
    """Whether two words over four letters begin alike for 70 % of the shorter one, four letters at least."""
    n = F.greatest(F.lit(4), F.floor(F.least(F.length(a), F.length(b)) * 0.7)).cast("int")
    return (F.length(a) > 4) & (F.length(b) > 4) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))


def overlap(query: Column, content: Column) -> Column:
    """The share of the query's words that the text has."""
    q = word_set(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, word_set(content))) / F.size(q)).otherwise(0.0)


def relevance(query: Column, content: Column, function_name: Column, class_name: Column, docstring: Column) -> Column:
    """Word overlap with boosts: 0.4 for each query word that fits the function's name, or 0.2 where only its root
    does; 0.3 once for the class; 0.2 once for the docstring; at most 1."""
    name = F.lower(_text(function_name))
    # bound once a row: what a lambda names is evaluated anew for each word
    bound = F.struct(word_set(query).alias("q"), overlap(query, content).alias("shared"), name.alias("function"), F.regexp_extract_all(name, F.lit("([a-z]+)"), F.lit(1)).alias("parts"), F.lower(_text(class_name)).alias("class"), F.lower(_text(docstring)).alias("doc"))
    inside = lambda name: lambda w: name.contains(w) | ((F.length(name) > 0) & w.contains(name))

    def score(s: Column) -> Column:
        boost = F.aggregate(s["q"], F.lit(0.0), lambda total, w: total + F.when(inside(s["function"])(w), 0.4).when(F.exists(s["parts"], lambda p: root_match(w, p)), 0.2).otherwise(0.0))
        named = F.when(F.exists(s["q"], inside(s["class"])), 0.3).otherwise(0.0)
        documented = F.when(F.exists(s["q"], lambda w: s["doc"].contains(w)), 0.2).otherwise(0.0)
        return F.least(F.lit(1.0), s["shared"] + boost + named + documented)

    return F.element_at(F.transform(F.array(bound), score), 1)


def balanced(content: Column) -> Column:
    return F.regexp_count(content, F.lit(r"[{(\[]")) == F.regexp_count(content, F.lit(r"[})\]]"))


def completeness(semantic_type: Column, content: Column) -> Column:
    """1 for a function or class with a head and a sign of a body, 0.5 without; of other chunks 1 with as many opening
    as closing brackets, else 0.7."""
    has = lambda *words: reduce(lambda a, b: a | b, [content.contains(w) for w in words])
    body = has("{", ":")
    function = F.when(has("def ", "function ", "fn ") & body, 1.0).otherwise(0.5)
    named = F.when(has("class ", "struct ") & body, 1.0).otherwise(0.5)
    other = F.when(balanced(content), 1.0).otherwise(0.7)
    return F.when(semantic_type.isin("function_definition", "async_function_definition"), function).when(semantic_type.isin("class_definition", "class_declaration"), named).otherwise(other)


def spaced(text: Column) -> Column:
    """Distinct words between white space, in small letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def cross_file(query: Column, import_statements: Column, dependencies: Column, file_path: Column) -> Column:
    """0.2 for each import that shares a word with the query, 0.15 for each dependency that holds one, 0.3 if the file's stem does; at most 1."""
    q = spaced(query)
    stem = F.lower(F.regexp_replace(F.element_at(F.split(file_path, "/"), -1), r"\.[^.]*$", ""))
    shares = F.size(F.filter(F.coalesce(import_statements, F.array().cast("array<string>")), lambda x: F.size(F.array_intersect(q, spaced(x))) > 0))
    holds = F.size(F.filter(F.coalesce(dependencies, F.array().cast("array<string>")), lambda d: F.exists(q, lambda w: F.lower(d).contains(w))))
    return F.least(F.lit(1.0), 0.2 * shares + 0.15 * holds + F.when(F.exists(q, lambda w: stem.contains(w)), 0.3).otherwise(0.0))


def context_score(query: Column, content: Column, import_statements: Column, file_path: Column, distance: Column) -> Column:
    """The rerank score: nearness in the graph, imports, calls and clusters, at most 1; distance is null without a path."""
    q = spaced(query)
    n = F.greatest(F.size(q), F.lit(1))
    near = F.when(distance.isNotNull(), 0.3 / (distance + 1)).otherwise(0.0)
    by_import = F.transform(F.coalesce(import_statements, F.array().cast("array<string>")), lambda x: F.size(F.array_intersect(q, spaced(x))) / n)
    imports = F.least(F.lit(1.0), F.aggregate(by_import, F.lit(0.0), lambda s, x: s + x))
    calls = F.size(F.filter(q, lambda w: F.lower(content).contains(w))) / n
    parent = F.lower(F.get(F.split(file_path, "/"), F.size(F.split(file_path, "/")) - 2))
    cluster = F.when(parent.isin(CLUSTERS), 0.5).otherwise(0.0)
    return F.least(F.lit(1.0), near + 0.2 * imports + 0.2 * calls + 0.3 * cluster)


def items(function_name: Column, class_name: Column, file_path: Column) -> Column:
    """What a chunk counts as in the metrics: its function, its class, its file."""
    named = lambda kind, c: F.when(c.isNotNull(), F.concat(F.lit(f"{kind}:"), c))
    return F.array_compact(F.array(named("function", function_name), named("class", class_name), named("file", F.element_at(F.split(file_path, "/"), -1))))


def precision_recall(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """(query_id, precision, recall) from ranked(query_id, rank, items) and qrels(query_id, item)."""
    top = ranked.where(F.col("rank") <= k)
    hits = top.select("query_id", F.explode("items").alias("item")).distinct().join(qrels.distinct(), ["query_id", "item"], "left_semi").groupBy("query_id").agg(F.count("*").alias("hits"))
    size = top.groupBy("query_id").agg(F.count("*").alias("n"))
    relevant = qrels.distinct().groupBy("query_id").agg(F.count("*").alias("relevant"))
    out = size.join(hits, "query_id", "left").join(relevant, "query_id", "left").fillna(0, ["hits", "relevant"])
    return out.select("query_id", (F.col("hits") / F.col("n")).alias("precision"), F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0).alias("recall"))


def average_precision(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, ap): precision at each relevant rank, over the number of relevant items; queries without a hit are left out.

    Hits are joined by query and item, so no row carries a query's relevant items; a query has each rank once.
    """
    wanted = qrels.where(F.col("item").isNotNull()).select("query_id", "item").distinct()
    hits = ranked.select("query_id", "rank", F.explode("items").alias("item")).join(wanted, ["query_id", "item"], "left_semi").select("query_id", "rank").distinct()
    sizes = wanted.groupBy("query_id").agg(F.count("*").alias("relevant"))
    running = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    sums = hits.select("query_id", (running / F.col("rank")).alias("precision")).groupBy("query_id").agg(F.sum("precision").alias("total"))
    return sums.join(sizes, "query_id").select("query_id", (F.col("total") / F.col("relevant")).alias("ap"))


def ndcg(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg) of (query_id, rank, score); the second rank is not discounted, and the ideal order is that of the scores found."""
    top = scores.where(F.col("rank") <= k)
    ideal = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))
    gain = lambda r: F.when(r == 1, F.col("score")).otherwise(F.col("score") / F.log2(r))
    out = top.withColumn("ideal", ideal).groupBy("query_id").agg(F.sum(gain(F.col("rank"))).alias("dcg"), F.sum(gain(F.col("ideal"))).alias("idcg"))
    return out.select("query_id", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def percentiles(rows: DataFrame, key: str, value: str, *ps: float) -> DataFrame:
    """(key, p<number> for each): the lower of the values about each percentile, exactly.

    Values are numbered in order within their key, and only the places asked for are kept: no group is collected.
    """
    known = rows.where(F.col(value).isNotNull())
    sizes = known.groupBy(key).agg(F.count("*").alias("n"))
    placed = known.select(key, value, F.row_number().over(Window.partitionBy(key).orderBy(value)).alias("place")).join(sizes, key)
    at = lambda p: F.floor(F.lit(p) / 100 * (F.col("n") - 1)) + 1
    return placed.where(reduce(lambda a, b: a | b, [F.col("place") == at(p) for p in ps])).groupBy(key).agg(*[F.max(F.when(F.col("place") == at(p), F.col(value))).alias(f"p{p:g}") for p in ps])


def compare(enhanced: DataFrame, base: DataFrame) -> DataFrame:
    """(metric, improvement in %) of two tables (metric, value) where the base is positive."""
    both = enhanced.select("metric", F.col("value").alias("e")).join(base.select("metric", F.col("value").alias("b")), "metric")
    return both.where("b > 0").select("metric", ((F.col("e") - F.col("b")) / F.col("b") * 100).alias("improvement"))
