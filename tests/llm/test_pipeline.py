import corpus_pipeline
from tests.llm import test_decontamination, test_lines, test_ngram_join, test_quality


def test_each_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rest = [(r.doc_id, r.lang, r.source) for r in docs.collect()]
    out = dict(corpus_pipeline.STAGES)

    def after(name, rows):
        df = spark.createDataFrame([(d, t, *next(x[1:] for x in rest if x[0] == d), len(t)) for d, t in rows], docs.schema)
        got = out[name](spark, df, sf)
        assert got.columns == docs.columns
        result = sorted((r.doc_id, r.text, r.n_chars) for r in got.collect())
        assert all(n == len(t) for _, t, n in result)
        return [x[:2] for x in result]

    kept = sorted((d, t) for d, t in rows if test_quality.brute(t)[6])
    assert after("quality rules", rows) == kept
    lines = [(d, t) for d, t in test_lines.brute(kept)[0] if t.strip()]
    assert after("line dedup", kept) == lines
    component = {d: c for d, _, c in test_ngram_join.brute(lines)}
    single = [(d, t) for d, t in lines if component[d] == d]
    assert after("n-gram Jaccard join", lines) == single
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {x[0] for x in test_decontamination.brute(single, items) if x[5]}
    clean = [(d, t) for d, t in single if d not in bad]
    assert after("benchmark decontamination", single) == clean
    drawn = after("mixing sources to target weights", clean)
    assert set(drawn) <= set(clean) and 0.4 * len(clean) < len(drawn) < len(clean)
    final = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.text) for r in final.collect()) == drawn
