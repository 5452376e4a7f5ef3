"""Clusters against plain comparison of all vectors with all centroids, in Python's whole numbers."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from lexarray.llm import centroids, queries
from tests.test_queries import SF, norm


def plain(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()), r[1])
    cent = [v for _, v in sorted(kept, key=name)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(cent)):
            mine = [v for (_, v), c in zip(kept, of, strict=True) if c == j]
            if mine:
                cent[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    total = sum(d for _, _, d in found)
    return sorted(((i, c, d, sum(y for _, x, y in found if x == c), total, hashlib.sha256(",".join(map(str, cent[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string")
    return sorted(map(tuple, centroids.centroid_clusters(df, **options).collect()), key=repr)


def floats(pick, dims):
    return [float(np.float32(pick.gauss(0, 1))) for _ in range(dims)]


def test_query(spark):
    df = queries.op12_centroid_clustering(spark, SF)
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    rows = duck.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()['op12_centroid_clustering']})").fetchall()
    assert rows and sorted(map(tuple, df.collect())) == sorted(tuple(map(norm, r)) for r in rows)


def test_clustered_ties_and_copies(spark):
    pick = random.Random(5)
    hubs = [floats(pick, 6) for _ in range(12)]
    rows = [(n, [float(np.float32(x + pick.gauss(0, 0.02))) for x in pick.choice(hubs)]) for n in range(700)]
    rows += [(1000 + n, [0.5, -0.5, 0.0, 0.0, 0.0, 0.0]) for n in range(400)]  # a third of all rows equal
    rows += [(n, rows[n][1]) for n in range(50)]  # repeated rows
    assert found(spark, rows, dims=6, k=9) == plain(rows, dims=6, k=9)


def test_grid_of_ties(spark):
    rows = [(n, [float(n % 5 - 2), float(n // 5 % 5 - 2)]) for n in range(200)]
    assert found(spark, rows, dims=2, scale=1, k=6, rounds=4) == plain(rows, dims=2, scale=1, k=6, rounds=4)


def test_cases(spark):
    good = [1.0, -0.25]
    rows = [(1, good), (1, good), (None, [0.0, 0.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0])]
    assert found(spark, rows, dims=2) == plain(rows, dims=2)
    assert found(spark, rows[3:], dims=2) == []
    assert found(spark, [], dims=2) == []
    with pytest.raises(Exception, match="beyond the range"):
        found(spark, [(1, [1e30, 0.0])], dims=2)


def test_tree_covers_and_prunes():
    """Every point lies in the nodes above it, within their radius; few pairs are compared where clusters are far apart."""
    pick = np.random.default_rng(2)
    points = (pick.integers(0, 4, (1000, 1)) * 100_000 + pick.integers(0, 50, (1000, 8))).astype(np.int64)
    tree = centroids.Tree(points, 8)
    assert sorted(tree.order) == list(range(1000))
    for a, b, c, r, (x, y) in zip(tree.first, tree.last, tree.center, tree.radius, tree.kids, strict=True):
        assert np.sqrt(((points[tree.order[a:b]] - points[c]).astype(float) ** 2).sum(1)).max() <= r * (1 + 1e-12)
        if y:
            assert (tree.first[x], tree.last[y - 1]) == (a, b) and (tree.first[x + 1 : y] == tree.last[x : y - 1]).all()
    _, n, *parts = centroids._packed(list(range(1000)), points)
    block = centroids.Block(n, 8, *parts)
    compared = []
    block._compare = lambda node, *rest: compared.append(len(node))
    block.assigned(np.array([[k * 100_000 + 25] * 1 + [25] * 7 for k in range(4)]) * 1, centroids.Tree(np.array([[k * 100_000 + 25] + [25] * 7 for k in range(4)]), 1))
    assert compared == [0]
