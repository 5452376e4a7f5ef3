import re

from lexarray.llm.ngram_join import ngram_components, one_of_each

SCHEMA = "doc_id long, text string"


def brute(rows):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_against_brute_force_on_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(ngram_components(docs)) == brute(rows)


def test_edge_cases_and_a_dense_group(spark):
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "one TWO"), (None, "one two"), (6, "one two three"), (7, "one two"), (7, "one two"), (8, "É a b c d"), (9, "é a b c d")]
    for i in range(120):
        w = list(words)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((100 + i, " ".join(w)))
    rows.append((999, "long " * 30000))
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], SCHEMA + ", component_id int").repartition(5)
    assert got(ngram_components(df)) == brute(rows)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.where("doc_id is null or doc_id < 100").collect()) == ["1", "2", "3", "4", "6", "8", "9"]


def test_one_row_of_each_group_stays(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "only here and nowhere else at all")
    rows = [(3, a, 1), (7, a, 1), (7, b, 1), (9, c, 1), (9, c, 1), (9, c, 2), (None, b, 1), (None, "no other has this text here", 1), (None, "no other has this text here", 1), (5, None, 1), (5, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    kept = sorted(((r.doc_id, r.text) for r in one_of_each(df).collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (9, c), (None, "no other has this text here"), (5, None), (5, None)], key=str)


def test_a_frequent_token_over_many_components(spark):
    shared = "these five words are common"
    rows = [(i, f"{shared} " + " ".join(f"d{i}w{j}" for j in range(3 + i % 5))) for i in range(300)] + [(1000 + i, shared) for i in range(3)]
    assert got(ngram_components(spark.createDataFrame(rows, SCHEMA).repartition(6))) == brute(rows)


def test_empty_table(spark):
    assert got(ngram_components(spark.createDataFrame([], SCHEMA))) == []
