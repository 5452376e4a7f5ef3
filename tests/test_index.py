"""The index of a folder, built in full and by changes, and the tools over it."""

import json
import os
import subprocess
import time

import pytest
from lexarray.api import ANSWER, Cancelled, Engine, Service, TaskRegistry
from lexarray.operators import evaluation
from lexarray.operators.index import IndexStore, Session, progress
from lexarray.settings import Settings, codebase, listed
from lexarray.sources.files import discover, discover_updates

PY = '''import helper


class Keeper(Base):
    """Keeps tokens."""

    def load_token(self, name: str) -> str:
        return helper.find(name)
'''


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "code"
    folder.mkdir()
    (folder / "keeper.py").write_text(PY)
    (folder / "helper.py").write_text("def find(name):\n    return name\n")
    (folder / "notes.css").write_text("\n".join(f".c{i} {{ color: red }}" for i in range(20)))
    (folder / "bad.py").write_bytes(b"x = 'a\xff\xfeb'\n")
    return folder


def test_full_and_incremental_index(spark, root, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.needs_reindexing(str(root)) and store.status()["status"] == "not_indexed"
    phases = []
    out = store.index(str(root), report=lambda phase, share: phases.append(share))
    assert out["status"] == "success" and out["changes"] == {"new": 4, "modified": 0, "deleted": 0}
    assert phases == [0.0, 25.0, 50.0, 75.0, 100.0] and out["languages_detected"] == ["css", "python"]
    chunks = store.chunks()
    rows = {(os.path.basename(r.file_path), r.semantic_type) for r in chunks.collect()}
    assert ("keeper.py", "class_definition") in rows and ("notes.css", "code_block") in rows and ("bad.py", "code_block") in rows
    assert sorted(r.rowid for r in chunks.select("rowid").collect()) == list(range(1, chunks.count() + 1))
    assert {(os.path.basename(r.dependent), r.dep_path) for r in store.dependents().collect()} == {("keeper.py", "helper.py")}
    assert not store.needs_reindexing(str(root)) and store.index(str(root))["status"] == "up_to_date"

    (root / "helper.py").write_text("def find_all(names):\n    return list(names)\n")
    os.utime(root / "helper.py", (2e9, 2e9))
    (root / "notes.css").unlink()
    (root / "more.go").write_text("func Add(a int) int {\n\treturn a\n}\n")
    changed = {k: [os.path.basename(p) for p in v] for k, v in store.changed_files(str(root)).items()}
    assert changed == {"modified": ["helper.py"], "new": ["more.go"], "deleted": ["notes.css"]}
    assert store.index(str(root))["changes"] == {"new": 1, "modified": 1, "deleted": 1}
    files = {os.path.basename(r.path) for r in store.records().collect()}
    assert files == {"keeper.py", "helper.py", "bad.py", "more.go"}
    assert store.chunks().where("content like '%find_all%'").count() == 1 and store.chunks().where("language = 'css'").count() == 0
    assert store.chunks().select("rowid").distinct().count() == store.chunks().count()
    assert [r.doc for r in store.bm25().search("find_all", 1).collect()] == [store.chunks().where("content like '%find_all%'").first().rowid]
    assert store.info()["tables"]["records"] == 4 and store.info()["size_mb"] > 0
    store.clear()
    assert store.chunks().isEmpty() and store.current() is None


def test_tools(spark, root, tmp_path):
    service = Service(IndexStore(spark, str(tmp_path / "index")))
    assert service.index_codebase(str(root / "none"))["status"] == "error"
    started = service.index_codebase(str(root), wait=True)
    assert started["status"] == "started" and service.tasks.tasks[started["task_id"]]["status"] == "completed"
    assert service.tasks.tasks[started["task_id"]]["progress"] == {"phase": "completed", "progress": 100.0}
    assert service.index_codebase(str(root))["status"] == "already_indexed"
    status = service.indexing_status(str(root))
    assert status["status"] == "success" and status["total_files"] == 4 and status["active_task"] is None
    engine = service.engine(str(root))
    path = str(root / "keeper.py")
    found = engine.search_in_file(path, "load token keeper", 5)
    assert found["status"] == "success" and {r["file_path"] for r in found["results"]} <= {path}
    assert engine.search_in_file(path, "load token keeper", 5, prefilter=True)["total_matches"] == 1
    assert engine.search_in_file(path, "x", 34)["status"] == "error"
    assert engine.search_bm25("load_token")["results"][0]["file_path"] == path
    assert engine.search_classes("Keeper")["results"][0]["docstring"] == "Keeps tokens."
    assert engine.search_functions("find")["status"] == "success" and engine.search_metadata("class keeper")["status"] == "success"
    assert engine.search_stats()["languages"]["python"] >= 3 and engine.health_check()["tools"] == 9
    assert service.search_code("load token")["status"] == "success"
    assert service.cancel_task("none")["status"] == "not_found" and service.clear_index()["status"] == "success"
    assert service.indexing_status(str(root))["index_status"] == "not_indexed"


def test_scans(spark, root):
    (root / "UP.PY").write_text("y = 1\n")
    (root / "out.log").write_text("z")
    assert {os.path.basename(r.path): r.content for r in discover(spark, str(root)).collect()}["bad.py"] == "x = 'ab'\n"
    assert {os.path.basename(r.path) for r in discover_updates(spark, str(root)).collect()} == {"keeper.py", "helper.py", "bad.py", "UP.PY"}
    assert "UP.PY" not in {os.path.basename(r.path) for r in discover(spark, str(root)).collect()}


def test_git_changes_reach_the_index(spark, root, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "x")
    (root / "helper.py").write_text("x = 3\n")
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.changed_files(str(root), use_git=True) == {"modified": [str(root / "helper.py")], "new": [], "deleted": []}


def test_settings_and_session(tmp_path, monkeypatch):
    monkeypatch.setenv("VEC_INDEX_TYPE", "hnsw")
    monkeypatch.setenv("ENABLE_QUANTIZATION", "False")
    assert Settings().index_type == "hnsw" and not Settings().quantize
    monkeypatch.setenv("VEC_INDEX_TYPE", "other")
    with pytest.raises(ValueError):
        Settings()
    (tmp_path / "f").write_text("")
    for bad, error in ((tmp_path / "none", FileNotFoundError), (tmp_path / "f", NotADirectoryError)):
        with pytest.raises(error):
            codebase(str(bad))
    assert listed("a, b ,c") == ["a", "b", "c"] and listed(None) is None
    assert progress(1, 4) == 25.0 and progress(0, 0) == 0.0
    session = Session()
    session.add("files_discovered", 4), session.add("files_processed", 3), session.log("begun")
    assert session.summary()["success_rate"] == 75.0


def test_sessions_are_rows_of_a_table(spark, tmp_path):
    (tmp_path / "code").mkdir()
    (tmp_path / "code" / "a.py").write_text("def f():\n    return 1\n")
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.log().collect() == []
    store.index(str(tmp_path / "code"))
    store.index(str(tmp_path / "code"))
    store.clear()
    first, second = sorted(store.log().collect(), key=lambda r: -len(r.lines))
    assert first.counters["files_processed"] == first.counters["files_discovered"] == 1 and first.counters["chunks_created"] == 1
    assert [x.split()[0] for x in first.lines] == ["discovering", "parsing", "embedding", "storing", "completed"]
    assert second.counters["files_processed"] == 0 and second.lines == ["discovering 0%"]



def test_evaluation_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["function:f", "file:a.py"]), (2, ["class:C", "file:b.py"])], "rank int, items array<string>")

    def search(query, language=None):
        if query == "broken":
            raise RuntimeError("no index")
        return rows

    queries = [{"query": "find f", "language": "python", "relevant": ["function:f", "class:C"]}, {"query": "none", "relevant": ["function:other"]}, {"query": "broken", "relevant": ["x"]}]
    out = evaluation.evaluate_method(spark, search, "m", queries)
    assert (out["total_queries"], out["successful_queries"]) == (3, 2) and out["individual_results"][2]["error"] == "no index"
    first = out["individual_results"][0]["metrics"]
    assert first["recall_at_5"] == 1.0 and first["mean_average_precision"] == 1.0 and out["aggregate_metrics"]["avg_recall_at_5"] == 0.5
    assert evaluation.evaluate_method(spark, search, "m", queries[2:])["aggregate_metrics"] is None
    times = evaluation.benchmark({"m": search}, ("a", "broken"))["m"]
    assert times["success_rate"] == 0.5 and times["avg_results_per_query"] == 2 and len(times["response_times"]) == 1
    growth = evaluation.scalability(spark, lambda chunks: (chunks.count(), lambda q: chunks.limit(1))[1], (100, 250))
    assert set(growth) == {100, 250} and evaluation.synthetic_chunks(spark, 250).select("file_path").distinct().count() == 3
    assert evaluation.lower_percentile([3.0, 1.0, 2.0], 95) == 2.0
    evaluation.report([out], {"m": times}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["evaluations"]["m"]["method"] == "m"


def test_cells_are_searched_where_settings_say_so(spark, root, tmp_path, monkeypatch):
    monkeypatch.setenv("VEC_INDEX_TYPE", "ivf")
    for k in range(12):
        (root / f"m{k}.py").write_text(f"def make_{k}(thing_{k}):\n    return 'word{k} ' * {k} + thing_{k}\n")
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.index(str(root))["status"] == "success"
    q = [float(x) for x in store.embed("make_3 thing_3")]
    near = store.near(q)
    assert 0 < near.count() <= store.chunks().count() and "cell=" in "".join(x for x in near.inputFiles())
    engine = Service(store).engine()
    exact = {r.rowid for r in Engine(store.chunks(), store.embed).semantic("return thing_3", n=3, threshold=None).collect()}
    found = {r.rowid for r in engine.semantic("return thing_3", n=3, threshold=None).collect()}
    assert len(found) == 3 and found & exact
    (root / "m3.py").write_text("def make_other():\n    return 5\n")
    os.utime(root / "m3.py", (2e9, 2e9))
    assert store.index(str(root))["changes"]["modified"] == 1
    every = {r.rowid for r in store.segments.read("vectors", "path string, rowid long, embedding array<float>, cell int").collect()}
    assert every == {r.rowid for r in store.chunks().collect()}
    assert set(engine.search_code("make", max_results=2)["results"][0]) == {*ANSWER, "score"}


def test_cancelling_ends_the_spark_job(spark):
    def slow():
        def wait(batches):
            import time

            for b in batches:
                time.sleep(60)
                yield b

        return spark.range(0, 4, 1, 4).mapInPandas(wait, "id long").count()

    tasks = TaskRegistry(spark)
    key, began = tasks.start("slow", slow), time.time()
    while not tasks.share(key)["jobs"] and time.time() - began < 30:
        time.sleep(0.1)
    assert tasks.share(key)["tasks"] >= 4 and tasks.cancel(key) == "success"
    while tasks.share(key)["jobs"] and time.time() - began < 50:
        time.sleep(0.1)
    assert time.time() - began < 50 and tasks.tasks[key]["status"] == "cancelled" and tasks.cancel(key) == "not_found"
    with pytest.raises(Cancelled):
        tasks.checked(key)


def test_average_precision_carries_no_query_s_items(spark):
    """Hits are joined by item: no row holds all relevant items of its query."""
    from lexarray.operators import quality

    ranked = spark.createDataFrame([("q", 1, ["a", "b"]), ("q", 2, ["x"]), ("q", 3, ["b", None]), ("r", 1, ["y"]), ("s", 1, ["a"])], "query_id string, rank int, items array<string>")
    qrels = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("q", "c"), ("q", None), ("r", "z")], "query_id string, item string")
    out = quality.average_precision(ranked, qrels)
    assert [(r["query_id"], round(r["ap"], 9)) for r in out.collect()] == [("q", round((1 / 1 + 2 / 3) / 3, 9))]
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tokenising_a_large_batch_holds_little(spark):
    """What Python holds is bounded by a run of texts, not by the Arrow batch; results are those of single texts."""
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    from lexarray.functions import tokenise

    texts = [None, ""] + [" ".join(f"w{(i * 7919 + j * 31) % 5000}x" for j in range(300)) for i in range(8000)]
    column = pa.array(texts)
    rows, split = spark.createDataFrame(list(enumerate(texts[:50])), "i int, t string"), tokenise.Tokeniser()
    found = rows.select(tokenise.tokens(rows.t).alias("x"), tokenise.counted(rows.t).alias("c")).orderBy("i").collect()
    for r, x in zip(found, texts, strict=False):
        assert r["x"] == split(x) and r["c"]["dl"] == len(split(x))
        assert dict(zip(r["c"]["terms"], r["c"]["tfs"], strict=True)) == dict(Counter(split(x)))
    tracemalloc.start()
    out = tokenise._counts(column, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == len(texts) and peak < 40e6


def test_plain_words_are_what_their_parts_are():
    from lexarray.functions.tokenise import Tokeniser

    words = "plain Plain pLain PLAIN Pl pl PL aB a_b the The THE ab abc éa Éa x1 1x İx".split()
    for raw in (False, True):
        split = Tokeniser(raw=raw)
        assert split(" ".join(words)) == [t for w in words for t in split.parts(w)]


def test_relevance_reads_names_once_a_row(spark):
    """Names that are split off a text are bound before the words of the query are gone through."""
    from pyspark.sql import functions as F

    from lexarray.operators import quality

    rows = spark.range(1).select(F.lit("a get_user b").alias("text"))
    word = lambda i: F.get(F.split("text", " "), i)
    out = rows.select(quality.relevance(F.lit("user table"), F.col("text"), word(1), word(2), F.col("text")).alias("x"))
    assert out.first()["x"] == pytest.approx(0.9)
    assert out._jdf.queryExecution().analyzed().toString().count("split(") <= 3
