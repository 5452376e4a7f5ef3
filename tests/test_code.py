import subprocess

from lexarray.api import Engine, TaskRegistry
from lexarray.operators import bm25, graph, incremental, quality, search
from lexarray.operators.chunking import chunks_of, nested_chunks_of, semantic_type_of, syntactic_chunks
from lexarray.operators.embed import embedded
from lexarray.plans import code_queries
from lexarray.plans.code_queries import JAVASCRIPT, PYTHON
from lexarray.sources.files import discover, git_changes
from pyspark.sql import functions as F


def test_python_chunks():
    found = chunks_of(PYTHON, "python")
    assert [(c["semantic_type"], c["start_line"], c["end_line"]) for c in found] == [("class_definition", 4, 14), ("async_function_definition", 15, 19)]
    assert found[0]["class_name"] == "UserManager" and found[0]["inheritance_chain"] == ["BaseManager"] and found[0]["docstring"] == "Keeps users."
    assert found[1]["function_signature"] == "def fetch(url: str) -> bytes" and found[1]["parameter_types"] == ["str"] and found[1]["complexity_score"] == 1
    assert chunks_of("def (", "python") == []


def test_javascript_chunks_ignore_braces_in_strings():
    found = chunks_of(JAVASCRIPT, "javascript")
    assert [c.get("class_name") or c.get("function_name") for c in found] == ["Counter", "greet"]
    assert found[0]["inheritance_chain"] == ["Base"]


def test_large_class_is_split():
    body = "\n".join(f"    def method_{i}(self):\n        value = {i} * 1000 + len('some longer text to fill the chunk {i}')\n        return value\n" for i in range(30))
    found = chunks_of("class Big:\n" + body, "python")
    assert len(found) > 3 and all(c["semantic_type"] == "function_definition" for c in found)


def test_complexity_and_tokens(spark):
    code = "def f(a):\n    if a:\n        while a:\n            pass\n    return a + 'x' * 3\n"
    assert chunks_of(code, "python")[0]["complexity_score"] == 3
    assert bm25.query_terms("calculate_user_score getUserData if") == {"calculate": 2, "user": 3, "score": 2, "getuserdata": 1, "get": 1, "data": 1}


def test_scan_and_git(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.js").write_text("y")
    (tmp_path / "c.PY").write_text("z")
    got = discover(spark, str(tmp_path), ["python", "nothing"]).collect()
    assert [(r.path.rsplit("/", 1)[1], r.language, r.content) for r in got] == [("a.py", "python", "x = 1\n")]
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "a.py"), git("commit", "-qm", "x")
    (tmp_path / "a.py").write_text("x = 2\n")
    assert {(r.status, r.path) for r in git_changes(spark, str(tmp_path)).collect()} == {("modified", "a.py"), ("new", "c.PY"), ("new", "node_modules/b.js")}


def test_graph_paths(spark):
    nodes = spark.createDataFrame([(x,) for x in "ABCD"], "id string")
    edges = spark.createDataFrame([("A", "B", "contains"), ("B", "C", "calls")], "source string, target string, relationship string")
    assert graph.shortest_path(nodes, edges, "A", "C") == ["A", "B", "C"]
    assert graph.shortest_path(nodes, edges, "A", "D") == [] and graph.shortest_path(nodes, edges, "A", "A") == ["A"]
    assert {r.id for r in graph.neighbourhood(nodes, edges, "B", 1).collect()} == {"A", "B", "C"}


def test_percentile_and_relevance(spark):
    rows = spark.range(1, 11).select(F.lit("a").alias("k"), "id").union(spark.createDataFrame([("b", 7), ("b", None)], "k string, id long"))
    assert {tuple(r) for r in quality.percentiles(rows, "k", "id", 50, 95).collect()} == {("a", 5, 9), ("b", 7, 7)}
    score = spark.range(1).select(quality.relevance(F.lit("authenticate user"), F.lit("def authenticate_user"), F.lit("authenticate_user"), F.lit(None).cast("string"), F.lit("checks a user")).alias("s")).first()
    assert score.s == 1.0


def test_first_writer_wins(spark):
    a = spark.createDataFrame([("f", 1, 2, "old", 1)], "file_path string, start_line int, end_line int, content string, rowid long")
    b = spark.createDataFrame([("f", 1, 2, "new", 2), ("f", 3, 4, "x", 3), ("f", 3, 4, "y", 4)], a.schema)
    assert sorted(r.content for r in incremental.insert_new(a, b).collect()) == ["old", "x"]


def test_engine_answers(spark):
    rows = [(i, f"f{i % 3}.py", f"def load_user_{i}(): return session token", "python", "function_definition", f"load_user_{i}") for i in range(9)]
    chunks = embedded(spark.createDataFrame(rows, "rowid long, file_path string, content string, language string, semantic_type string, function_name string"))
    engine = Engine(chunks)
    out = engine.search_code("session token load", max_results=150, similarity_threshold=1.5)
    assert out["status"] == "success" and len(out["results"]) == 9
    assert engine.search_by_type("function_definition", max_results=-5)["status"] == "success"
    assert search.route("function that returns bool") == ("return_type", "s")


def test_tasks_keep_their_end():
    import time

    tasks = TaskRegistry()
    key = tasks.start("a", lambda: 5)
    for _ in range(100):
        if tasks.tasks[key]["status"] == "completed":
            break
        time.sleep(0.01)
    assert tasks.tasks[key]["result"] == 5 and tasks.cancel(key) == "not_found" and tasks.cancel("none") == "not_found"


def test_short_neighbours_are_merged_without_repeating_lines():
    text = "def f():\n    return 1\n\ndef g():\n    return 2\n\n"
    found = chunks_of(text, "python")
    assert [(c["start_line"], c["end_line"], c["semantic_type"], c["function_name"]) for c in found] == [(1, 6, "function_definition", "f")]
    assert found[0]["content"] == text[:-1]
    two = chunks_of("class A:\n    x = 1\n\ndef g():\n    return 2\n", "python")
    assert [c["semantic_type"] for c in two] == ["class_definition", "function_definition"]


def test_nested_chunks_types_and_file_imports(spark):
    assert [c["semantic_type"] for c in nested_chunks_of(PYTHON, "python")] == ["import_statement", "class_definition", "function_definition", "async_function_definition"]
    assert [c["semantic_type"] for c in nested_chunks_of("x = 1\ny = 2", "python")] == ["code_block"]
    assert semantic_type_of(PYTHON, "python") == "class_definition" and semantic_type_of("x = 1", "python") == "code_block"
    found = syntactic_chunks(spark.createDataFrame([("a.py", "python", PYTHON)], "path string, language string, content string")).collect()
    assert all(r.import_statements == ["import os", "from typing import Any"] and r.dependencies == ["os", "typing"] for r in found)
    inner = [c for c in nested_chunks_of(PYTHON, "python") if c.get("function_name") == "find"]
    assert inner[0]["parameter_types"] == ["str"]  # a typed default does not count


def test_signatures_of_languages_with_braces():
    java = chunks_of("public class A extends B implements C, D {\n  private int size;\n}\n", "java")[0]
    assert (java["class_name"], java["inheritance_chain"], java["interfaces"]) == ("A", ["B"], ["C", "D"])
    one = lambda text, language: nested_chunks_of(text, language)[0]
    m = one("  public static int add(int a, List<String> b) {\n    return a;\n  }\n", "java")
    assert (m["function_name"], m["parameter_types"], m["return_type"]) == ("add", ["int", "List<String>"], "int")
    g = one("func (s *Server) Get(name string, n int) error {\n\treturn nil\n}\n", "go")
    assert (g["function_name"], g["parameter_types"], g["return_type"]) == ("Get", ["string", "int"], "error")
    r = one("pub fn load(path: &str, n: usize) -> Option<u8> {\n    None\n}\n", "rust")
    assert (r["function_name"], r["parameter_types"], r["return_type"]) == ("load", ["&str", "usize"], "Option<u8>")
    t = one("export function f(a: string, b = 2): number {\n  return 1;\n}\n", "typescript")
    assert (t["function_name"], t["parameter_types"], t["return_type"]) == ("f", ["string"], "number")
    arrow = one("const load = async (x) => {\n  return x;\n}\n", "javascript")
    assert (arrow["semantic_type"], arrow["function_name"]) == ("function_declaration", "load")


def test_context_score_counts_words_once(spark):
    score = lambda q, imports, path: spark.range(1).select(quality.context_score(F.lit(q), F.lit(""), F.array(*map(F.lit, imports)), F.lit(path), F.lit(None).cast("int")).alias("s")).first().s
    assert abs(score("user user login", ["import user"], "src/Auth/x.py") - (0.2 * 0.5 + 0.15)) < 1e-9
    done = lambda kind, text: spark.range(1).select(quality.completeness(F.lit(kind), F.lit(text)).alias("s")).first().s
    assert [done("function_definition", "def f(a:\n  x"), done("class_declaration", "public struct X {"), done("code_block", "(("), done("class_definition", "x")] == [1.0, 1.0, 0.7, 0.5]


def test_long_paths_and_chains_are_found_whole(spark):
    n = 40
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(n + 1)], "id string")
    edges = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}", "x") for i in range(n)], "source string, target string, relationship string")
    assert len(graph.shortest_path(nodes, edges, "n00", f"n{n}")) == n + 1
    pairs = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)] + [("n25", "n0")], "child string, parent string")
    assert graph.ancestors(pairs).where("root = 'n0'").agg(F.max("depth")).first()[0] == 25


def test_stored_index_ranks_as_the_unstored(spark, tmp_path):
    rows = [(i, "python", f"alpha beta{' gamma' * (i % 3)} word{i}") for i in range(20)] + [(20, "go", None), (21, "go", "")]
    index = bm25.build(spark.createDataFrame(rows, "rowid long, language string, content string"))
    stored = bm25.Stored.write(index, str(tmp_path / "a"))
    for query, language in (("gamma word3 gamma", None), ("alpha", "python"), ("none there", None), ("", None)):
        plain = [(r.doc, round(r.score, 9)) for r in bm25.search(index, query, 5, language).collect()]
        assert [(r.doc, round(r.score, 9)) for r in stored.search(query, 5, language).collect()] == plain
    assert stored.stats().first() == bm25.stats(index).first()
    after = stored.update(index.where("doc < 5").select("doc"), index.where("doc = 21"), str(tmp_path / "b"))
    assert after.docs.count() == 17


def test_routing_and_expansion_as_columns(spark):
    asked = ["function that returns bool", "Functions named größe_1", "class that inherits from Base", "class\nUserManager", "class A\nB import os", "import", "", "Get user DATA, save error config", "x function\nreturn y", "auth login token"]
    rows = spark.createDataFrame(list(enumerate(asked)), "i int, q string").select("i", search.route_of(F.col("q")).alias("r"), search.expanded(F.col("q")).alias("x"))
    for r in rows.collect():
        assert tuple(r.r) == search.route(asked[r.i]) and r.x == search.expand_query(asked[r.i]), asked[r.i]


def test_counted_index_is_shuffled_once(spark, tmp_path):
    rows = [(i, "en", f"alpha beta{i % 3} beta{i % 3} gamma {'delta ' * (i % 4)}") for i in range(30)] + [(40, None, None), (41, "fr", "")]
    chunks = spark.createDataFrame(rows, "rowid long, language string, content string")
    plain, counts = bm25.build(chunks), bm25.build_counted(chunks)
    stored = bm25.Stored.write(counts, str(tmp_path / "a"))
    key = lambda df: sorted((r.term, r.doc, r.tf) for r in df.collect())
    assert key(stored.postings) == key(bm25.Stored.write(plain, str(tmp_path / "b")).postings) == key(bm25.postings(plain))
    # a document's terms are written once each, with their counts
    assert [(sorted(r.terms), sum(r.tfs)) for r in stored.docs.where("doc = 3").collect()] == [(["alpha", "beta0", "delta", "gamma"], 7)]
    ranked = lambda df: [(r.doc, round(r.score, 9)) for r in df.collect()]
    query = "alpha beta1 delta delta unknown"
    assert ranked(bm25.search(stored.docs, query, 9)) == ranked(bm25.search(plain, query, 9)) == ranked(stored.search(query, 9))
    changed = bm25.update(bm25.occurrences(stored.docs, query), counts.where("doc < 9").select("doc"), bm25.occurrences(counts.where("doc = 4"), query))
    assert ranked(bm25.best(changed, query, 9)) == ranked(bm25.search(plain.where("doc >= 9 or doc = 4"), query, 9))


def test_parts_of_one_row_group_are_parsed_by_many_tasks(spark, tmp_path):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    parts.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for name in ("code_metadata", "syntactic_chunks"):
        rows = code_queries.queries()[name](spark, str(tmp_path))
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() > 1, name
