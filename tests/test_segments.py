"""Segments: what a change writes, merging, bounds, a stream given twice, git."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lexarray.operators import bm25
from lexarray.operators.index import IndexStore
from lexarray.operators.segments import FANOUT, Segments
from lexarray.plans import index_queries
from lexarray.sources import files
from lexarray.streaming.index import stream_segments

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc long, path string, language string, content string")


def made(n, start=0):
    return [(i, f"f{i}", "en" if i % 3 else "fr", " ".join(WORDS[(i * k) % len(WORDS)] for k in range(1, 3 + i % 7)) + f" own{i}") for i in range(start, start + n)]


def ranked(df):
    return [(r.doc, round(r.score, 9)) for r in df.collect()]


def by_plain(spark, rows, query, n, language=None):
    chunks = rows_of(spark, rows).withColumnRenamed("doc", "rowid")
    return ranked(bm25.search(bm25.build(chunks), query, n, language))


def test_changes_and_merges(spark, tmp_path):
    store, now = Segments(spark, str(tmp_path / "s")), {r[1]: r for r in made(200)}
    full = store.add(texts=rows_of(spark, list(now.values())))
    for k in range(2 * FANOUT + 1):
        fresh = [(1000 + k, f"f{k}", "en", f"alpha changed{k} beta")] + ([(2000 + k, f"new{k}", "fr", "gamma gamma")] if k % 2 else [])
        gone = [(f"f{k}",), (f"f{50 + k}",), ("never there",)]
        done = store.add(texts=rows_of(spark, fresh), removed=spark.createDataFrame(gone, "path string"))
        for (path,) in gone:
            now.pop(path, None)
        now |= {r[1]: r for r in fresh}
        assert done["docs_added"] == len(fresh) and done["docs_removed"] == 2 and done["bytes"] < full["bytes"]
        assert done["segments"] <= 2 * FANOUT
    rows = list(now.values())
    assert sorted(r.path for r in store.documents().select("path").collect()) == sorted(now)
    for query, language in (("alpha beta", None), ("gamma own7 own120", None), ("alpha gamma changed3", "en"), ("nowhere", None)):
        assert ranked(store.search(query, 8, language)) == by_plain(spark, rows, query, 8, language), query
    stats = store.stats().first()
    assert (stats.n_docs, stats.n_terms) == (len(rows), store.postings().select("term").distinct().count())
    left = set(os.listdir(tmp_path / "s"))
    assert len(left) <= 1 + 2 * len(store.manifest()["segments"]) + 2 * (2 * FANOUT + 1) and "manifest" in left


def test_bounds_leave_ranges_out(spark, tmp_path):
    store = Segments(spark, str(tmp_path / "s"))
    rows = [(i, f"p{i}", "en", "common " + "filler " * (i % 50 + 20) + ("rare rare rare" if i in (900, 1700) else "")) for i in range(3000)]
    store.add(texts=rows_of(spark, rows).coalesce(1))
    report = {}
    found = ranked(store.search("rare common", 2, report=report))
    assert found == by_plain(spark, rows, "rare common", 2) and {d for d, _ in found} == {900, 1700}
    assert report["read"] * 10 < report["ranges"]


def test_two_writers(spark, tmp_path):
    store = Segments(spark, str(tmp_path / "s"))
    store.add(texts=rows_of(spark, made(3)))
    with pytest.raises(Exception, match="exist"):
        store._publish(store.manifest())


def test_a_batch_given_twice_changes_nothing(spark, tmp_path):
    files = str(tmp_path / "in")
    rows_of(spark, made(20)).withColumn("version", F.lit(1)).coalesce(1).write.parquet(files)
    store = Segments(spark, str(tmp_path / "s"))
    for checkpoint in ("a", "b"):  # a new checkpoint gives the same batch again
        stream = spark.readStream.schema("doc long, path string, language string, content string, version int").parquet(files)
        stream_segments(stream, store, str(tmp_path / checkpoint)).awaitTermination()
    assert store.manifest()["version"] == 1 and store.documents().count() == 20


def test_pruned_reads_less(spark):
    report = {}
    index_queries.stored_segments(spark, SF).search("erblest", 1, report=report)
    assert 0 < report["read"] <= report["ranges"]


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.email=a@b", "-c", "user.name=n", *args], check=True, capture_output=True)


@pytest.fixture
def work_tree(tmp_path):
    sub = tmp_path / "top" / "sub"
    sub.mkdir(parents=True)
    for name in ("a.py", "b.py", "c.py", "notes.txt"):
        (sub / name).write_text(f"def {name[0]}():\n    return '{name * 5}'\n")
    (tmp_path / "top" / "other.py").write_text("x = 1\n")
    git(tmp_path / "top", "init", "-q"), git(tmp_path / "top", "add", "."), git(tmp_path / "top", "commit", "-qm", "x")
    return sub


def test_git_source_in_a_subfolder(spark, work_tree):
    (work_tree / "a.py").write_text("def a():\n    return 2\n")
    (work_tree / "new one.py").write_text("y = 1\n")
    (work_tree / "notes.txt").write_text("no source")
    (work_tree.parent / "other.py").write_text("x = 2\n")
    git(work_tree, "mv", "b.py", "moved.py"), git(work_tree, "rm", "-q", "c.py")
    found = {(r.path, r.status) for r in files.git_changes(spark, str(work_tree)).collect()}
    assert found == {("a.py", "modified"), ("new one.py", "new"), ("moved.py", "new"), ("b.py", "deleted"), ("c.py", "deleted")}
    spark.dataSource.register(files.GitStatus)
    assert {r.code for r in spark.read.format("git_status").load(str(work_tree)).where("path = 'moved.py'").collect()} == {"R "}


def test_driver_asks_git(spark, work_tree, tmp_path):
    store, root = IndexStore(spark, str(tmp_path / "index")), str(work_tree)
    (work_tree / "a.py").write_text("def a():\n    return 'dirty when indexed'\n")
    store.index(root)
    assert store.index(root)["status"] == "up_to_date"
    git(work_tree, "checkout", "-q", "a.py")  # as committed again: git alone would not name it
    (work_tree / "b.py").write_text("def b_changed():\n    return 3\n")
    (work_tree / "c.py").unlink()
    for name in ("a.py", "b.py"):
        os.utime(work_tree / name, (2e9, 2e9))
    git(work_tree, "add", "."), git(work_tree, "commit", "-qm", "y")
    out = store.index(root)
    assert out["changes"] == {"new": 0, "modified": 2, "deleted": 1} and out["session"]["files_discovered"] == 2
    assert {os.path.basename(r.path) for r in store.records().collect()} == {"a.py", "b.py"}
    assert store.chunks().where("content like '%dirty%'").isEmpty() and not store.bm25().search("b_changed", 1).isEmpty()
    assert out["written"]["docs_removed"] == 3


def test_streamed_versions_are_no_single_task(spark, tmp_path, monkeypatch):
    """A table of several files is streamed by several files a version, with the same end."""
    from lexarray.plans import index_queries

    docs, counts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), []
    through = index_queries.stream_segments

    def counted(files, store, checkpoint):
        counts.append(len(spark.read.parquet(store.folder.removesuffix("store") + "files").inputFiles()))
        return through(files, store, checkpoint)

    monkeypatch.setattr(index_queries, "stream_segments", counted)
    found = []
    for n in (1, 5):
        docs.repartition(n, "doc_id").write.parquet(f"{tmp_path}/{n}/documents.parquet")
        found.append(sorted(map(tuple, index_queries.stream_upserts(spark, f"{tmp_path}/{n}").collect()), key=repr))
    assert found[0] == found[1] and counts[1] > counts[0]


def test_blocks_share_rows_and_files_are_many(spark, tmp_path, monkeypatch):
    """Postings are dealt packed: a row holds a term's blocks of many ranges, and no file holds all of a frequent term."""
    monkeypatch.setattr("lexarray.operators.segments._FILE", 300, raising=False)
    rows = [(i, path, None if i % 7 == 0 else language, content) for i, path, language, content in made(3000)]
    store = Segments(spark, str(tmp_path / "s"))
    store.add(texts=rows_of(spark, rows))
    stored = spark.read.parquet(f"{store.folder}/{store.manifest()['segments'][0]['name']}/postings")
    held = stored.where("term = 'alpha'")
    assert held.select(F.input_file_name()).distinct().count() > 1
    assert held.count() * 3 < len({(i >> 6, language) for i, _, language, content in rows if "alpha" in content.split()})
    assert {(r.term, r.doc, r.language, r.tf, r.dl) for r in store.postings().collect()} == {(t, i, language, content.split().count(t), len(content.split())) for i, _, language, content in rows for t in content.split()}
    for query, language in (("alpha beta own77", None), ("gamma own7 own1200", "fr"), ("zeta alpha", "en")):
        report = {}
        assert ranked(store.search(query, 8, language, report=report)) == by_plain(spark, rows, query, 8, language), query
        assert 0 < report["read"] <= report["ranges"]
