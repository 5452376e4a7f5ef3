from collections import defaultdict
import re

import pytest

from lexarray.llm.mixing import mixed, mixture


def fitted(cells, targets, rounds=200):
    """cells: {(a, b, c): tokens}; targets: for each place the shares."""
    total = sum(cells.values())
    mass = dict(cells)
    for _ in range(rounds):
        for place, shares in enumerate(targets):
            margin = defaultdict(float)
            for k, m in mass.items():
                margin[k[place]] += m
            mass = {k: m * shares[k[place]] * total / margin[k[place]] for k, m in mass.items()}
    return {k: m / cells[k] for k, m in mass.items()}


def powered(cells, place, power):
    margin = defaultdict(float)
    for k, n in cells.items():
        margin[k[place]] += n
    total = sum(margin.values())
    x = {k: (n / total) ** power for k, n in margin.items()}
    return {k: v / sum(x.values()) for k, v in x.items()}


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixed(docs).collect()
    assert len(rows) == docs.count()
    cells = defaultdict(int)
    for r in rows:
        assert r.tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.d.text))
        cells[r.source, r.lang, r.topic] += r.tokens
    weights = fitted(cells, [powered(cells, 0, 0.7), {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}, powered(cells, 2, 0.8)])
    for r in rows:
        assert r.weight == pytest.approx(weights[r.source, r.lang, r.topic], rel=5e-3, abs=1e-6)
    total = sum(cells.values())
    assert sum(r.tokens * r.probability for r in rows) == pytest.approx(0.5 * total, rel=1e-3)
    rate = max(r.probability / r.weight for r in rows if r.weight > 0)
    assert all(r.probability == pytest.approx(min(1, rate * r.weight), rel=1e-6) for r in rows)
    assert sum(r.tokens for r in rows if r.sampled) == pytest.approx(0.5 * total, rel=0.15)
    assert mixture(docs).columns == docs.columns
    assert sorted(r.doc_id for r in mixture(docs).collect()) == sorted(r.d.doc_id for r in rows if r.sampled)


def test_edge_cases(spark):
    rows = [(1, None, "s", "en"), (2, "", None, None), (3, "a b", "", "xx"), (None, "a " * 50000, "s", "en"), (5, "a b", "s", "fr"), (5, "a b", "s", "fr")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, source string, lang string, weight double")
    got = mixed(df).collect()
    assert len(got) == 6 and all(0 <= r.probability <= 1 for r in got)
    assert len({(r.sampled, r.probability) for r in got if r.d.doc_id == 5}) == 1
    assert {r.d.doc_id: r.tokens for r in got} == {1: 0, 2: 0, 3: 2, None: 50000, 5: 2}
    assert mixed(df.limit(0)).collect() == []
    assert mixed(df, fraction=1.0).where("not sampled and tokens > 0 and lang <> 'xx'").count() == 0


def test_no_python_in_the_plan(spark):
    df = mixed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    df.collect()
    assert not re.search("Python|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_values_without_a_target_are_drawn(spark):
    langs = ["en", "fr", "de", "es", "it", None, ""]
    rows = [(i, "a b c d", "s", langs[i % 7]) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixed(df).collect()
    assert all(r.probability > 0 for r in got)
    assert sum(r.tokens * r.weight for r in got if r.lang in ("it", "")) == pytest.approx(280 * 3 / 7, rel=1e-3)
    assert sum(r.tokens * r.weight for r in got if r.lang == "en") == pytest.approx(280 * 4 / 7 * 0.55, rel=1e-3)
    assert mixture(df, fraction=1.0).count() == 70
