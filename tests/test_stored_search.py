"""The inverted file of vectors and the trigram index against exact searches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarray.functions.vector import distance
from lexarray.operators import search
from lexarray.operators.cells import VectorCells
from lexarray.operators.trigrams import Trigrams, pattern_grams

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


def test_recall_and_files(spark, vectors, tmp_path):
    cells, reports, hits = VectorCells.write(vectors, str(tmp_path / "c")), [], []
    assert cells.spark.read.parquet(str(tmp_path / "c" / "vectors")).count() == vectors.count()
    for r in vectors.where("vec_id % 50 = 0").collect():
        report = {}
        near = {x.vec_id for x in cells.search(r.embedding, 10, report=report).collect()}
        exact = {x.vec_id for x in search.knn(vectors, r.embedding, 10).collect()}
        hits.append(len(near & exact) / 10), reports.append(report)
    assert sum(hits) / len(hits) >= 0.9, hits
    assert all(x["read"] < x["files"] for x in reports)


def test_clustered_vectors_need_few_cells(spark, tmp_path):
    pick = np.random.default_rng(1)
    hubs = pick.normal(size=(25, 16))
    rows = [(i, (hubs[i % 25] + 0.05 * pick.normal(size=16)).tolist()) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cells, report = VectorCells.write(df, str(tmp_path / "c")), {}
    near = {x.vec_id for x in cells.search(rows[7][1], 10, report=report).collect()}
    assert near == {x.vec_id for x in search.knn(df, rows[7][1], 10).collect()} and report["read"] * 3 < report["files"]


def test_copies_nulls_and_few(spark, tmp_path):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(500 + i, [0.0, float(i)]) for i in range(5)] + [(900, None), (901, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    cells = VectorCells.write(df, str(tmp_path / "c"))
    found = cells.search([0.0, 1.0], 4, probes=len(cells.centers)).collect()
    assert [r.vec_id for r in found] == [r.vec_id for r in search.knn(df.where("embedding is not null"), [0.0, 1.0], 4).collect()]
    one = VectorCells.write(df.limit(1), str(tmp_path / "one"))
    assert [r.vec_id for r in one.search([1.0, 0.0], 3).collect()] == [0]


@pytest.mark.parametrize("pattern", ["abc", "AbC", "a%cab", "b_bc", "ab", "%", "nothing here", "ca\\b", "éÉx"])
def test_patterns(spark, tmp_path_factory, pattern):
    texts = ["abcabc", "xxABCxx", "a--cab", "bXbc", "ca\\b", "ÉéX", "ab", "", None, "aabbcc"]
    rows = spark.createDataFrame([(i, t, [t or "q", "z"], "en") for i, t in enumerate(texts * 40)], "rowid long, content string, names array<string>, language string")
    index = Trigrams.write(rows, ["content", "names"], str(tmp_path_factory.mktemp("t") / "i"))
    want = [r.rowid for r in search.keyword_search(rows, pattern, n=1000).collect()]
    assert [r.rowid for r in search.keyword_search(index.narrowed([("content", pattern)]), pattern, n=1000).collect()] == want
    if pattern_grams(pattern):
        assert index.candidates("content", pattern).count() < rows.count()


def test_few_rows_are_read(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("rowid"), F.concat(F.lit("text number "), "id").alias("content"))
    index = Trigrams.write(rows, ["content"], str(tmp_path / "i"))
    assert index.candidates("content", "number 1777").count() <= 200
    assert sorted(r.content for r in search.keyword_search(index.narrowed([("content", "number 1777")]), "number 1777").collect()) == sorted(f"text number {i}" for i in [1777, *range(17770, 17780)])


@pytest.mark.parametrize("metric", ["cosine", "l2", "dot"])
def test_many_queries_equal_pairs_one_by_one(spark, metric):
    """Ties of copies, zero vectors, other dimensions, nulls and non-finite components: as distance() has them, in any split."""
    from pyspark.sql import Window

    pick = random.Random(5)
    rows = [(i, [float(pick.randint(-2, 2)) for _ in range(3)]) for i in range(300)] + [(i, [1.0, 2.0, 3.0]) for i in range(300, 340)]
    rows += [(340, [0.0] * 3), (341, None), (342, [1.0, 2.0]), (343, [1.0, None, 2.0]), (344, [float("inf"), 1.0, 1.0]), (345, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 20 = 0 or vec_id > 338").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = queries.join(vectors, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", distance(F.col("embedding"), F.col("q"), metric).alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "vec_id"))
    want = pairs.withColumn("rank", rank).where("rank <= 5").collect()
    for block in (7, 1000):
        found = search.knn_of(queries, vectors, 5, metric, block=block)
        assert sorted(map(repr, found.select("query_id", "vec_id", "distance", "rank").collect())) == sorted(map(repr, want))
    assert "MapInArrow" in search.knn_of(queries, vectors, 5, metric)._jdf.queryExecution().toString()


def test_trigrams_of_a_block_are_those_of_its_texts():
    """A block's trigrams are found as numbers; long texts make small blocks, so that what is held is bounded by bytes."""
    import pyarrow as pa

    from lexarray.operators import trigrams

    texts, keys = ["", "ab", "abc", "abcabc", "éß日本語x😀😀😀", "a b c", "aaaaaa", "c", "\x00\x00\x00x"], range(100, 109)
    want: dict[str, list[int]] = {}
    for key, text in zip(keys, texts, strict=True):
        for gram in trigrams.grams_of(text):
            want.setdefault(gram, []).append(key)
    grams, n, rows = trigrams._held(pa.array(texts), pa.array(keys))
    assert dict(zip(grams.to_pylist(), rows.to_pylist(), strict=True)) == want and n.to_pylist() == list(map(len, rows.to_pylist()))
    assert len(trigrams._held(pa.array(["", "ab"]), pa.array([1, 2]))[0]) == 0
    long = "x" * (trigrams._CHARS + 1)
    assert list(trigrams._runs(pa.array(["a"] * 300 + [long, "b"]))) == [(0, 256), (256, 300), (300, 301), (301, 302)]


def test_centers_are_learned_from_directions_by_batches(spark, monkeypatch):
    """k-means is given vectors of unit length, each added up once and not once a component."""
    from lexarray.operators import cells

    given = []
    fit = cells.KMeans.fit
    monkeypatch.setattr(cells.KMeans, "fit", lambda self, rows: given.append(rows) or fit(self, rows))
    rows = [(i, [float(i), 1.0, 0.0]) for i in range(1, 9)] + [(9, [0.0, 0.0, 0.0]), (10, None)]
    centers = cells.learned(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cells=2)
    assert centers.shape == (2, 3)
    lengths = sorted(round(float(np.linalg.norm(r["features"].toArray())), 9) for r in given[0].collect())
    assert lengths == [0.0] + [1.0] * 8
    assert "aggregate(" not in given[0]._jdf.queryExecution().optimizedPlan().toString()
