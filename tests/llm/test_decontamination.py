import hashlib
import re

from lexarray.llm.decontamination import contamination, uncontaminated


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        if item is not None and n:
            windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1)]
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i] == x[0] and w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(str(item))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=str)


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any(x[5] for x in expected)
    assert got(contamination(docs, items)) == expected
    assert uncontaminated(docs, items).count() == sum(not x[5] for x in expected)


def test_edge_cases(spark):
    long = " ".join(f"q{i}" for i in range(30))
    items = [(1, long), (10, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14"), (2, "One."), (3, "a b c"), (4, None), (5, " .. "), (None, "zz yy"), (2, "one"), (6, "éa b c d e f")]
    docs = [(1, None), (2, ""), (3, "one, two"), (4, "A b C"), (5, long + " tail"), (5, long + " tail"), (5, "zz yy"), (None, "one"), (6, "x " * 500 + long), (7, ("pad " * 40 + "q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15 ") * 3), (8, "ÉA b c d e f"), (9, "éA-b_c d e\nf" + " z" * 9000)]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, n_hit int")
    i = spark.createDataFrame(items, "item_id long, text string")
    assert got(contamination(d, i)) == brute(docs, items)
    assert uncontaminated(d, i).columns == d.columns


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert [r.n_hit for r in contamination(d, i.limit(0)).collect()] == [0]
    assert contamination(d.limit(0), i).collect() == []
