"""Evaluation runs: search methods against benchmark queries, latency, growth and the report."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.operators import quality

#: The metrics of a query, and the queries that latency is measured with.
METRICS = ("precision_at_5", "precision_at_10", "recall_at_5", "recall_at_10", "mean_average_precision", "ndcg_at_5", "ndcg_at_10", "query_time_ms")
LATENCY_QUERIES = ("user authentication", "database operations", "error handling", "async functions", "class inheritance")
GROWTH_QUERIES = ("test function", "example class", "sample code")
GROWTH_SIZES = (100, 1000, 5000, 10000)


def item_score(item: Column, wanted: Column) -> Column:
    """1 for a wanted item, 0.5 where one holds the other in small letters without _ and -, else 0."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[_-]", "")
    part = F.exists(wanted, lambda w: bare(w).contains(bare(item)) | bare(item).contains(bare(w)))
    return F.when(F.array_contains(wanted, item), 1.0).when(part, 0.5).otherwise(0.0)


def graded(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, rank, score): the items of all results in order, one after another, with their scores."""
    flat = ranked.select("query_id", "rank", F.posexplode("items").alias("i", "item"))
    wanted = qrels.groupBy("query_id").agg(F.sort_array(F.collect_set("item")).alias("wanted"))
    # each different item is compared once, and what is sorted carries its score only
    scored = flat.select("query_id", "item").distinct().join(wanted, "query_id").select("query_id", "item", item_score(F.col("item"), F.col("wanted")).alias("score"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "i"))
    return flat.join(scored, ["query_id", "item"], "left").select("query_id", place.alias("rank"), F.coalesce("score", F.lit(0.0)).alias("score"))


def evaluated(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """A row for each query with results: precision and recall at 5 and 10, average precision (0 without a hit), nDCG."""
    out = ranked.select("query_id").distinct()
    for k in (5, 10):
        out = out.join(quality.precision_recall(ranked, qrels, k).select("query_id", F.col("precision").alias(f"precision_at_{k}"), F.col("recall").alias(f"recall_at_{k}")), "query_id", "left")
        out = out.join(quality.ndcg(graded(ranked, qrels), k).select("query_id", F.col("ndcg").alias(f"ndcg_at_{k}")), "query_id", "left")
    out = out.join(quality.average_precision(ranked, qrels).select("query_id", F.col("ap").alias("mean_average_precision")), "query_id", "left")
    return out.fillna(0.0)


def aggregated(metrics: DataFrame) -> DataFrame:
    """(metric, avg, min, max) over queries of every metric column there is."""
    names = [m for m in METRICS if m in metrics.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names]))
    rows = metrics.select(pairs.alias("x")).select("x.*")
    return rows.groupBy("metric").agg(F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))


Search = Callable[[str, str | None], DataFrame]


def evaluate_method(spark: SparkSession, search: Search, name: str, queries: list[dict]) -> dict:
    """One method over queries (query, language, relevant items): a row of metrics each, failures recorded.

    search gives rows (rank, items); each query's few results reach the driver, as they do for a user.
    """
    rows, answers, wanted, spent = [], [], [], 0.0
    for i, q in enumerate(queries):
        began = time.perf_counter()
        try:
            found = [(i, r["rank"], list(r["items"])) for r in search(q["query"], q.get("language")).collect()]
            took = (time.perf_counter() - began) * 1000
            spent += took
            answers += found
            wanted += [(i, x) for x in q["relevant"]]
            rows.append({"query": q["query"], "language": q.get("language"), "query_type": q.get("query_type"), "results": len(found), "query_time_ms": took})
        except Exception as e:  # noqa: BLE001  a failed query is part of the result
            rows.append({"query": q["query"], "error": str(e), "metrics": None})
    done = [i for i, r in enumerate(rows) if "error" not in r]
    if not done:
        return {"method": name, "total_queries": len(queries), "successful_queries": 0, "aggregate_metrics": None, "individual_results": rows}
    ranked = spark.createDataFrame(answers, "query_id int, rank int, items array<string>")
    qrels = spark.createDataFrame(wanted, "query_id int, item string")
    found = {r["query_id"]: r.asDict() for r in evaluated(ranked, qrels).collect()}
    each = []
    for i in done:
        own = {m: found.get(i, {}).get(m, 0.0) for m in METRICS[:-1]} | {"query_time_ms": rows[i]["query_time_ms"]}
        rows[i]["metrics"] = own
        each.append(own)
    summary = aggregated(spark.createDataFrame(each)).collect()
    metrics = {f"{kind}_{r['metric']}": r[kind] for r in summary for kind in ("avg", "min", "max")}
    return {"method": name, "total_queries": len(queries), "successful_queries": len(done), "average_query_time_ms": spent / len(queries), "aggregate_metrics": metrics, "individual_results": rows}


def lower_percentile(values: list[float], p: float) -> float:
    ordered = sorted(values)
    return ordered[int(p / 100 * (len(ordered) - 1))] if ordered else 0.0


def benchmark(searches: dict[str, Callable[[str], DataFrame]], queries: tuple[str, ...] = LATENCY_QUERIES) -> dict:
    """For each method: mean and percentiles of its times, the share of queries with results, and how many they had."""
    out = {}
    for name, search in searches.items():
        times, counts = [], []
        for q in queries:
            began = time.perf_counter()
            try:
                n = len(search(q).collect())
                times.append((time.perf_counter() - began) * 1000)
                counts.append(n)
            except Exception:  # noqa: BLE001  a failed query counts as one without results
                counts.append(0)
        hits = [n for n in counts if n]
        out[name] = {
            "total_queries": len(queries),
            "response_times": times,
            "success_rate": len(hits) / len(queries),
            "avg_results_per_query": sum(hits) / len(hits) if hits else 0,
            "avg_response_time_ms": sum(times) / len(times) if times else 0,
            "p95_response_time_ms": lower_percentile(times, 95),
            "p99_response_time_ms": lower_percentile(times, 99),
        }
    return out


def synthetic_chunks(spark: SparkSession, n: int) -> DataFrame:
    i = F.col("id").cast("string")
    return spark.range(n).select(
        F.concat(F.lit("test_"), F.floor(F.col("id") / 100).cast("string"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("def test_function_"), i, F.lit("():\n    return "), i).alias("content"),
        (F.col("id") * 3).cast("int").alias("start_line"),
        (F.col("id") * 3 + 2).cast("int").alias("end_line"),
        F.lit("python").alias("language"),
        F.lit("function_definition").alias("semantic_type"),
        F.concat(F.lit("test_function_"), i).alias("function_name"),
        F.col("id").alias("rowid"),
    )


def scalability(spark: SparkSession, build: Callable[[DataFrame], Callable[[str], DataFrame]], sizes: tuple[int, ...] = GROWTH_SIZES) -> dict:
    """For each size: the time to index synthetic chunks, and the mean time of a search over them."""
    out = {}
    for n in sizes:
        began = time.perf_counter()
        search = build(synthetic_chunks(spark, n))
        indexed = (time.perf_counter() - began) * 1000
        times = []
        for q in GROWTH_QUERIES:
            began = time.perf_counter()
            search(q).collect()
            times.append((time.perf_counter() - began) * 1000)
        out[n] = {"indexing_time_ms": indexed, "avg_search_time_ms": sum(times) / len(times)}
    return out


def report(evaluations: list[dict], benchmarks: dict, path: str | None = None) -> dict:
    """Evaluations and benchmarks as one answer, written as JSON where a path is given."""
    out = {"generated": time.strftime("%Y-%m-%dT%H:%M:%S"), "evaluations": {e["method"]: e for e in evaluations}, "benchmarks": benchmarks}
    if path is not None:
        with open(path, "w") as f:
            json.dump(out, f, indent=2)
    return out
