"""The index of a codebase: chunks, file records and an inverted index in a folder, built in full or by changes.

Each run commits one segment with the rows of the files that changed and tombstones of what they replace; rows and postings
of other files stay where they are. Readers never see half of a commit, and a lost run leaves the index as it was.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexarray.operators import cells, graph, incremental
from lexarray.operators.chunking import SCHEMA, syntactic_chunks
from lexarray.operators.embed import embedded, hashed
from lexarray.operators.lines import line_chunks
from lexarray.operators.segments import Segments
from lexarray.settings import Settings, codebase
from lexarray.sources.files import discover, git_changes, git_commit, git_names, in_work_tree

RECORDS = "path string, file_hash string, last_indexed timestamp, language string, chunk_ids array<string>, dependencies array<string>"
LOG = "session string, lines array<string>, counters map<string, double>"
CHUNKS = f"{SCHEMA}, language string, rowid long, embedding array<float>"


def chunked(files: DataFrame) -> DataFrame:
    """Chunks of files (path, language, content): by syntax, or by windows of lines where that gives none."""
    parsed = syntactic_chunks(files)
    rest = files.join(parsed.select(F.col("file_path").alias("path")).distinct(), "path", "left_anti")
    windows = line_chunks(rest.select(F.col("path").alias("file_path"), "content"))
    rows = parsed.unionByName(windows, allowMissingColumns=True)
    return rows.join(files.select(F.col("path").alias("file_path"), "language"), "file_path")


def numbered(chunks: DataFrame, after: int = 0) -> DataFrame:
    """chunks with rowid: by file, then by line, from after + 1 on; numbered within the files' ranges, not in one task."""
    rows = chunks.repartitionByRange("file_path").sortWithinPartitions("file_path", "start_line", "end_line")
    rows = graph.cut(rows.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id() % (1 << 33)))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return rows.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn("rowid", F.col("_before") + F.col("_n") + 1 + after).drop("_part", "_n", "_size", "_before")


_VECTORS = "path string, rowid long, embedding array<float>, cell int"


class Session:
    """Counters of one indexing run and its log."""

    def __init__(self) -> None:
        self.id, self.began = time.strftime("%Y%m%d_%H%M%S"), time.time()
        self.counts = dict.fromkeys(("files_discovered", "files_processed", "files_failed", "chunks_created", "embeddings_generated", "database_operations"), 0)
        self.lines: list[str] = []

    def add(self, name: str, n: int) -> None:
        self.counts[name] += n

    def log(self, line: str) -> None:
        self.lines.append(line)

    def summary(self) -> dict:
        spent = (time.time() - self.began) * 1000
        done = self.counts["files_processed"]
        return {"session": self.id, **self.counts, "total_processing_time": spent, "average_file_time": spent / done if done else 0, "success_rate": done / max(1, self.counts["files_discovered"]) * 100}

    def write(self, spark: SparkSession, path: str) -> None:
        """Appends the run as one row of a table that all executors share."""
        row = self.summary()
        spark.createDataFrame([(row.pop("session"), self.lines, {k: float(v) for k, v in row.items()})], LOG).coalesce(1).write.mode("append").parquet(path)


def progress(done: int, total: int) -> float:
    """A percentage; nothing to do is none done."""
    return done / total * 100 if total > 0 else 0.0


class IndexStore:
    """Tables chunks and records and an inverted index, as segments under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, embed: Callable | None = None, settings: Settings | None = None) -> None:
        self.settings = settings or Settings()
        self.spark, self.folder, self.embed = spark, folder or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), self.settings.index_folder), embed or hashed
        self.segments = Segments(spark, self.folder, {"vectors": "cell"})

    def current(self) -> int | None:
        """The number of the last commit."""
        return self.segments.manifest()["version"] or None

    def chunks(self) -> DataFrame:
        return self.segments.read("chunks", f"{CHUNKS}, path string").drop("path")

    def records(self) -> DataFrame:
        return self.segments.read("records", RECORDS)

    def bm25(self) -> Segments | None:
        return self.segments if self.current() else None

    def near(self, query: list[float]) -> DataFrame | None:
        """(rowid, embedding) of the cells nearest to a vector; None where the index is flat, so that all vectors count."""
        m = self.segments.manifest()
        if self.settings.index_type == "flat" or "centers" not in m["marks"]:
            return None
        wanted = cells.probed(self._centers(m["marks"]["centers"]), query, m["marks"]["probes"])
        return self.segments.read("vectors", _VECTORS, m).where(F.col("cell").isin(wanted)).select("rowid", "embedding")

    def _centers(self, name: str) -> np.ndarray:
        return np.array([r["center"] for r in self.spark.read.parquet(f"{self.folder}/{name}").orderBy("cell").collect()])  # cells.MOST_CELLS at most

    def _in_cells(self, chunks: DataFrame, marks: dict) -> tuple[dict, dict]:
        """The table of vectors by cell, and marks of the cells: those of the first run that has vectors hold for later ones."""
        rows = chunks.where("embedding is not null").select(F.col("file_path").alias("path"), "rowid", "embedding")
        own = {k: marks[k] for k in ("centers", "probes", "folders") if k in marks}
        if not own:
            centers = cells.learned(rows, "rowid")
            if not len(centers):
                return {}, {}
            probes = cells.probes_for(rows.withColumn("cell", cells.cell_of(F.col("embedding"), centers)), centers, "rowid", "embedding")
            name = f"centers-{uuid.uuid4().hex[:8]}"
            self.spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centers)], "cell int, center array<double>").write.parquet(f"{self.folder}/{name}")
            own = {"centers": name, "probes": probes, "folders": [name]}
        return {"vectors": rows.withColumn("cell", cells.cell_of(F.col("embedding"), self._centers(own["centers"])))}, own

    def dependents(self) -> DataFrame:
        """(dep_path, dependent): which indexed files import which, from the records as they are now: a new file may be what
        an old one imports."""
        root, every = self.segments.manifest()["marks"].get("root", ""), self.records()
        modules = every.select(F.col("path").alias("dependent"), F.explode("dependencies").alias("module"))
        below = every.select(F.expr(f"substring(path, {len(root) + 2})").alias("path"))
        return graph.resolve(modules, below).select("dep_path", "dependent")

    def log(self) -> DataFrame:
        """The runs so far, one row each, from a table beside the index; clearing the index keeps it."""
        path = f"{self.folder}_log"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(path)

    def clear(self) -> None:
        self.segments.clear()

    def info(self) -> dict:
        """Version, tables and their rows, bytes on disk."""
        return {"version": self.spark.version, "tables": {"chunks": self.chunks().count(), "records": self.records().count()}, "index_type": self.settings.index_type, "size_mb": self.segments.size() / 1048576}

    def status(self) -> dict:
        """Counts by language and type, files, the newest time, size."""
        chunks, records = self.chunks(), self.records()
        last = records.agg(F.max("last_indexed")).first()[0]
        by = lambda c: {r[0]: r[1] for r in chunks.groupBy(c).count().collect()}
        n = chunks.count()
        return {"status": "indexed" if n else "not_indexed", "total_chunks": n, "total_files": records.count(), "languages": by("language"), "types": by("semantic_type"), "last_updated": last.isoformat() if last else None, "index_size_mb": self.info()["size_mb"]}

    # changes
    def changes(self, root: str, current: DataFrame | None = None, use_git: bool = False) -> DataFrame:
        """(path, status) of the files that differ from the records, by times and digests.

        use_git: only of those that git names as changed since the commit that was indexed, where that is known; what git
        names but the records already have is no change. Without git, or an indexed commit, all files are looked at."""
        root = codebase(root)
        records = self.records().where(F.col("path").startswith(root + "/"))
        names = self._named(root) if use_git else None
        if names is not None:
            found = discover(self.spark, root, names=names) if current is None else current
            return incremental.detect_changes(records.where(F.col("path").isin(names)), found.select("path", "modified", "file_hash"))
        if use_git and in_work_tree(root) and records.isEmpty():
            return git_changes(self.spark, root).select(F.concat(F.lit(root + "/"), "path").alias("path"), "status")
        found = discover(self.spark, root) if current is None else current
        return incremental.detect_changes(records, found.select("path", "modified", "file_hash"))

    def _named(self, root: str) -> list[str] | None:
        """The files that git names as changed since the indexed commit, or that differed from it when they were indexed."""
        marks = self.segments.manifest()["marks"]
        names = git_names(root, marks.get("commit")) if marks.get("root") == root else None
        return None if names is None else sorted(f"{root}/{x}" for x in {*names, *marks.get("dirty", [])})

    def changed_files(self, root: str, **options: object) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {"modified": [], "new": [], "deleted": []}
        for r in self.changes(root, **options).orderBy("path").collect():
            out[r["status"]].append(r["path"])
        return out

    def needs_reindexing(self, root: str) -> bool:
        """Whether nothing is indexed or anything has changed; also where that cannot be told."""
        try:
            return self.records().isEmpty() or not self.changes(root).isEmpty()
        except Exception:  # noqa: BLE001  what cannot be checked is indexed again
            return True

    def index(self, root: str, languages: list[str] | None = None, exclude: tuple[str, ...] = (), report: Callable[[str, float], None] = lambda phase, share: None, use_git: bool = True) -> dict:
        """Indexes a folder: in full where nothing is indexed, else what has changed; languages and exclusions hold both times.
        use_git: in a work tree only files that git names are read; elsewhere all are."""
        root, session = codebase(root), Session()
        told = report

        def report(phase: str, share: float) -> None:
            session.log(f"{phase} {share:g}%")
            told(phase, share)

        report("discovering", 0.0)
        store, marks = self.segments, self.segments.manifest()["marks"]
        first = self.records().isEmpty()
        commit = git_commit(root)
        dirty = (git_names(root, commit) or []) if commit else []
        files = graph.cut(discover(self.spark, root, languages, exclude, self.settings.max_file_mb, None if first or not use_git else self._named(root)))
        changes = graph.cut(files.select("path", F.lit("new").alias("status")) if first else self.changes(root, files, use_git))
        tally = changes.select("status").unionByName(files.select(F.lit("discovered").alias("status")))
        counts = {r[0]: r[1] for r in tally.groupBy("status").count().collect()}  # four rows at most
        session.add("files_discovered", counts.pop("discovered", 0))
        if not counts:
            session.write(self.spark, f"{self.folder}_log")
            return {"status": "up_to_date", "session": session.summary()}
        report("parsing", 25.0)
        gone = changes.where("status in ('deleted', 'modified')")
        fresh = files.join(changes.where("status <> 'deleted'").select("path"), "path", "left_semi")
        after = marks.get("last_row", 0)
        chunks = numbered(incremental.first_of_key(chunked(fresh)), after)
        report("embedding", 50.0)
        chunks = embedded(chunks, self.embed, self.settings.batch_size) if self.settings.embedding_enabled else chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        chunks = graph.cut(chunks)
        report("storing", 75.0)
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        own = chunks.groupBy(F.col("file_path").alias("path")).agg(F.collect_list(F.concat_ws(":", "file_path", "start_line")).alias("chunk_ids"), F.array_distinct(F.flatten(F.collect_set(F.coalesce("dependencies", F.array().cast("array<string>"))))).alias("dependencies"))
        fresh_records = fresh.join(own, "path", "left").select("path", "file_hash", F.current_timestamp().alias("last_indexed"), "language", "chunk_ids", "dependencies")
        texts = chunks.select(F.col("rowid").alias("doc"), F.col("file_path").alias("path"), "language", "content")
        seen = counts.get("new", 0) + counts.get("modified", 0)
        vectors, kept = self._in_cells(chunks, marks) if self.settings.index_type != "flat" and self.settings.embedding_enabled else ({}, {})
        done = store.add(vectors | {"chunks": chunks.select(*names, F.col("file_path").alias("path")), "records": fresh_records}, texts, gone.select("path"), lambda added: {"last_row": after + added, "root": root, "commit": commit, "dirty": dirty, **kept})
        n = done["docs_added"]
        session.add("chunks_created", n), session.add("embeddings_generated", n), session.add("files_processed", seen)
        session.add("database_operations", 3)
        report("completed", 100.0)
        session.write(self.spark, f"{self.folder}_log")
        return {"status": "success", "changes": {k: counts.get(k, 0) for k in ("new", "modified", "deleted")}, "languages_detected": sorted(r[0] for r in self.records().select("language").distinct().collect()), "written": done, "session": session.summary()}
