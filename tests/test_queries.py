"""Every query of the library with SQL gives the same rows as DuckDB on the same tables."""

import math

import duckdb
import pytest

from lexarray.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(norm, r)) for r in df.select(*columns).collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert rows
        return
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted((tuple(norm(r[i]) for i in order) for r in found.fetchall()), key=repr) == rows
