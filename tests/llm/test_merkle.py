"""The manifest against a plain tree over lists."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lexarray.llm import merkle, queries
from tests.test_queries import SF

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root, and for each leaf the digests beside its path."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            a = i // 8 * 8
            paths[k].append((level[a:i], level[i + 1 : a + 8]))
        level = [digest("".join(level[a : a + 8])) for a in range(0, len(level), 8)]
        at = [i // 8 for i in at]
    return level[0], paths


def plain(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in by[g]])
    root, above = tree([trees[g][0] for g in groups]) if groups else (None, [])
    out = []
    for k, g in enumerate(groups):
        for r, path in zip(by[g], trees[g][1], strict=True):
            path = path + above[k]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            found = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if tampered else leaf(r)
            for left, right in path:
                found = digest("".join([*left, found, *right]))
            out.append((r[0], leaf(r), trees[g][0], root, digest("".join("".join(a + b) for a, b in path)), found, found == root))
    return sorted(out, key=repr)


def query(spark, tmp_path, rows, partitions=4):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, place int")
    path = str(tmp_path / f"t{len(rows)}-{partitions}")
    df.repartition(partitions).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, queries.op11_merkle_manifest(spark, path).collect()), key=repr)


def test_query(spark):
    df = queries.op11_merkle_manifest(spark, SF)
    found = sorted(map(tuple, df.collect()))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert found == sorted(duck.execute(f"select {', '.join(df.columns)} from ({queries.oracle_sql()['op11_merkle_manifest']})").fetchall())
    rows = [tuple(r[c] for c in COLUMNS) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(found, key=repr) == plain(rows)
    assert {v for *_, v in found} == {True, False}


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 577])
def test_sizes(spark, tmp_path, n):
    rows = [(i, "s", "en" if i % 5 else f"l{i % 3}", i, f"Text {i}") for i in range(n)]
    assert query(spark, tmp_path, rows) == plain(rows)


def test_cases(spark, tmp_path):
    rows = [(7, "s", "en", 1, "Copy")] * 300 + [(7, "s", "en", 1, f"Other {i}") for i in range(20)]  # one id, mostly one row
    rows += [(None, None, None, None, None), (None, "s", None, 2, "A"), (-5, "s", None, 3, ""), (3, "s", "", 4, "B"), (4, "é", "é", 5, "É" * 20_000), (9, "s", "alone", 6, None)]
    assert query(spark, tmp_path, rows) == plain(rows)
    assert query(spark, tmp_path, []) == []


def test_many_ranges_and_groups(spark):
    """Runs that start and end anywhere in groups, and more groups than ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = [(i, "s", "en" if i < 700 else f"g{i:04}", i, f"t{i}") for i in range(900)]
        df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
        found = merkle.merkle_manifest(df).withColumn("ok", merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).collect()
        want = {r[0]: r for r in plain(rows)}
        assert len(found) == 900 and all(r["ok"] and (r["leaf"], r["subroot"], r["root"]) == want[r["doc_id"]][1:4] for r in found)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
