"""The tools' façade: calls that return JSON-like dictionaries and never raise, and a registry of tasks."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.functions import vector
from lexarray.operators import bm25, fusion, search
from lexarray.operators.index import IndexStore
from lexarray.settings import codebase, listed


def enveloped(call: Callable[..., dict]) -> Callable[..., dict]:
    def run(*args: Any, **options: Any) -> dict:
        try:
            return {"status": "success"} | call(*args, **options)
        except Exception as e:  # noqa: BLE001  the outermost layer turns errors into answers
            return {"status": "error", "message": str(e), "error_type": type(e).__name__}

    return run


class Cancelled(Exception):
    """The task was cancelled."""


class TaskRegistry:
    """Background tasks: pending, running, completed, failed or cancelled; a finished task keeps its status."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        """spark: its jobs that a task starts carry the task's key as a tag, so that cancelling ends them."""
        self.tasks: dict[str, dict] = {}
        self.lock, self.spark = threading.Lock(), spark

    def start(self, name: str, work: Callable[[], Any]) -> str:
        key = str(uuid.uuid4())
        with self.lock:
            self.tasks[key] = {"name": name, "status": "pending", "started": time.time(), "result": None}

        def run() -> None:
            self._set(key, "running")
            if self.spark is not None:
                self.spark.sparkContext.addJobTag(key)
            try:
                out = work()
                self._set(key, "completed", result=out)
            except Exception as e:  # noqa: BLE001
                self._set(key, "failed", result=str(e))

        threading.Thread(target=run, daemon=True).start()
        return key

    def _set(self, key: str, status: str, **more: Any) -> None:
        with self.lock:
            if self.tasks[key]["status"] in ("pending", "running"):
                self.tasks[key] |= {"status": status, "ended": time.time(), **more}

    def cancel(self, key: str) -> str:
        with self.lock:
            task = self.tasks.get(key)
            if task is None or task["status"] not in ("pending", "running"):
                return "not_found"
            task |= {"status": "cancelled", "ended": time.time()}
        if self.spark is not None:
            self.spark.sparkContext.cancelJobsWithTag(key)
        return "success"

    def checked(self, key: str) -> None:
        """Raises where the task is cancelled: its work calls this between jobs."""
        if self.tasks.get(key, {}).get("status") == "cancelled":
            raise Cancelled(key)

    def share(self, key: str) -> dict[str, int]:
        """How many jobs of a task Spark runs now, and how many of their tasks are done."""
        if self.spark is None:
            return {"jobs": 0, "tasks": 0, "done": 0}
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [j for j in self.spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(key) if (info := tracker.getJobInfo(j)) and info.status == "RUNNING"]
        stages = [x for j in jobs for s in tracker.getJobInfo(j).stageIds if (x := tracker.getStageInfo(s))]
        return {"jobs": len(jobs), "tasks": sum(x.numTasks for x in stages), "done": sum(x.numCompletedTasks for x in stages)}

    def active(self, name: str) -> list[str]:
        return [k for k, t in self.tasks.items() if t["name"] == name and t["status"] in ("pending", "running")]

    def cleanup(self, age: float = 24 * 3600) -> None:
        with self.lock:
            self.tasks = {k: t for k, t in self.tasks.items() if t["status"] in ("pending", "running") or time.time() - t.get("ended", time.time()) < age}


#: The columns of an answer's chunks.
ANSWER = "file_path content start_line end_line language semantic_type function_signature class_name function_name parameter_types return_type inheritance_chain import_statements docstring complexity_score dependencies interfaces decorators".split()


class Engine:
    """Searches over a chunk table with rowid, file_path, content, language, semantic_type and embedding."""

    def __init__(self, chunks: DataFrame, embed: Callable[[str], Any] | None = None, stored: Any = None, quantize: bool = False, near: Callable[[list[float]], DataFrame | None] = lambda q: None) -> None:
        from lexarray.operators.embed import hashed

        self.chunks, self.embed, self.tasks, self.quantize, self.near = chunks, embed or hashed, TaskRegistry(), quantize, near
        self.index = stored or bm25.build(chunks)

    @staticmethod
    def _clamped(n: int, threshold: float) -> tuple[int, float]:
        return max(1, min(100, n)), max(0.0, min(1.0, threshold))

    def _bm25(self, query: str, n: int = 50, language: str | None = None) -> DataFrame:
        return self.index.search(query, n, language) if hasattr(self.index, "search") else bm25.search(self.index, query, n, language)

    def _with_chunks(self, found: DataFrame, *order: Any) -> DataFrame:
        return self.chunks.join(F.broadcast(found), F.col("rowid") == F.col("doc")).orderBy(*order)

    def semantic(self, query: str, language: str | None = None, n: int = 10, threshold: float | None = 0.7, prefilter: Any = None) -> DataFrame:
        """The chunks nearest to the query, with similarity; the language applies to the n chunks found."""
        q = [float(x) for x in self.embed(query)]
        some = self.near(q) if prefilter is None else None
        vectors = self.chunks if some is None else some
        if self.quantize:
            vectors = vectors.withColumn("embedding", vector.quantize(F.col("embedding")))
        near = search.knn(vectors, q, n, threshold=None if threshold is None else 1 - threshold, prefilter=prefilter, key="rowid")
        if some is not None:
            near = self.chunks.join(F.broadcast(near.select("rowid", "distance")), "rowid")  # n rows
        if language:
            near = near.where(F.col("language") == language)
        return near.withColumn("similarity", F.round(1 - F.col("distance"), 3))

    def hybrid(self, query: str, language: str | None = None, n: int = 10, threshold: float = 0.7) -> DataFrame:
        """BM25, nearest vectors and, where the query asks for it, metadata, fused; three chunks a file at most."""
        n, threshold = self._clamped(n, threshold)
        legs = [fusion.ranked(self._bm25(query, 50, language), F.desc("score"), "doc")]
        near = self.semantic(query, language, n, threshold)
        legs.append(fusion.ranked(near, "distance", "rowid").withColumnRenamed("rowid", "doc"))
        if search.wants_metadata(query) and "function_name" in self.chunks.columns:
            legs.append(fusion.ranked(search.search_metadata(self.chunks, query), *search.metadata_order(query)).withColumnRenamed("rowid", "doc"))
        fused = fusion.fuse([x.select("doc", "rank") for x in legs])
        order = (F.desc("score"), "first_leg", "first_rank")
        rows = self.chunks.join(F.broadcast(fused), F.col("rowid") == F.col("doc"))
        return fusion.diverse(rows, "file_path", *order).orderBy(*order).limit(n)

    def _answered(self, *more: str) -> list[str]:
        """The columns of an answer: those of ANSWER that the chunks have, and some more."""
        return [*(c for c in ANSWER if c in self.chunks.columns), *more]

    @staticmethod
    def _rows(rows: DataFrame, *columns: str) -> list[dict]:
        """A short answer's rows, without vectors."""
        return [r.asDict() for r in (rows.select(*columns) if columns else rows.drop("embedding")).collect()]

    def search_code(self, query: str, language: str | None = None, max_results: int = 10, similarity_threshold: float = 0.7) -> dict:
        return enveloped(lambda: {"results": self._rows(self.hybrid(query, language, max_results, similarity_threshold), *self._answered("score"))})()

    def search_by_type(self, kind: str, language: str | None = None, max_results: int = 20) -> dict:
        return enveloped(lambda: {"results": self._rows(search.search_by_type(self.chunks, kind, language, max(1, min(100, max_results))), *self._answered())})()

    def search_in_file(self, file_path: str, query: str, max_results: int = 5, prefilter: bool = False) -> dict:
        """Of the max_results * 3 chunks nearest in all files those of one file; prefilter: the nearest of the file itself."""

        def call() -> dict:
            own = F.col("file_path") == file_path
            found = self.semantic(query, n=max_results, threshold=None, prefilter=own) if prefilter else self.semantic(query, n=max_results * 3, threshold=0.7).where(own).orderBy("distance", "rowid").limit(max_results)
            rows = self._rows(found, "file_path", "content", "start_line", "end_line", "similarity")
            return {"results": rows, "total_matches": len(rows), "file_path": file_path, "query": query}

        if not prefilter and not 1 <= max_results * 3 <= 100:
            return {"status": "error", "message": f"max_results out of range: {max_results}", "error_type": "ValueError", "file_path": file_path}
        return enveloped(call)()

    def search_bm25(self, query: str, language: str | None = None, max_results: int = 10) -> dict:
        return enveloped(lambda: {"results": self._rows(self._with_chunks(self._bm25(query, max_results, language), F.desc("score"), "doc"))})()

    def search_metadata(self, query: str, max_results: int = 10) -> dict:
        return enveloped(lambda: {"results": self._rows(search.search_metadata(self.chunks, query, max_results))})()

    def search_functions(self, name: str | None = None, returns: str | None = None, parameters: tuple[str, ...] = (), language: str | None = None, max_results: int = 50) -> dict:
        return enveloped(lambda: {"results": self._rows(search.search_functions(self.chunks, name, returns, parameters, language, max_results))})()

    def search_classes(self, name: str | None = None, inherits: str | None = None, implements: str | None = None, max_results: int = 50) -> dict:
        return enveloped(lambda: {"results": self._rows(search.search_classes(self.chunks, name, inherits, implements, max_results))})()

    def search_stats(self) -> dict:
        capabilities = ["semantic", "bm25", "metadata", "hybrid", "by_type", "in_file"]
        return enveloped(lambda: {"total": self.chunks.count(), "languages": {r[0]: r[1] for r in self.chunks.groupBy("language").count().collect()}, "types": {r[0]: r[1] for r in self.chunks.groupBy("semantic_type").count().collect()}, "capabilities": capabilities})()

    def health_check(self) -> dict:
        return enveloped(lambda: {"chunks": self.chunks.count(), "tools": len(TOOLS)})()


#: The calls that are offered as tools.
TOOLS = ("index_codebase", "indexing_status", "clear_index", "cancel_task", "search_code", "search_by_type", "search_in_file", "search_stats", "health_check")


class Service:
    """The tools over an index on disk: indexing in the background, its status, and searches of the newest snapshot."""

    def __init__(self, store: IndexStore) -> None:
        self.store, self.tasks = store, TaskRegistry(store.spark)

    def index_codebase(self, path: str, languages: str | None = None, exclude: str | None = None, wait: bool = False) -> dict:
        """started with the task's id, already_running, already_indexed where nothing has changed, or an error."""

        def call() -> dict:
            root = codebase(path)
            running = self.tasks.active(root)
            if running:
                return {"status": "already_running", "task_id": running[0]}
            if not self.store.needs_reindexing(root):
                return {"status": "already_indexed", **{k: v for k, v in self.store.status().items() if k != "status"}}
            share: dict = {"phase": "pending", "progress": 0.0}
            known: list[str] = []

            def report(phase: str, done: float) -> None:
                share.update(phase=phase, progress=done)
                if known:
                    self.tasks.checked(known[0])

            key = self.tasks.start(root, lambda: self.store.index(root, listed(languages), tuple(listed(exclude) or ()), report))
            known.append(key)
            self.tasks.tasks[key]["progress"] = share
            while wait and self.tasks.active(root):
                time.sleep(0.05)
            return {"status": "started", "task_id": key}

        return enveloped(call)()

    def indexing_status(self, path: str) -> dict:
        def call() -> dict:
            running = self.tasks.active(codebase(path))
            return {**{f"index_{k}" if k == "status" else k: v for k, v in self.store.status().items()}, "active_task": running and {"task_id": running[0], **self.tasks.tasks[running[0]].get("progress", {}), "spark": self.tasks.share(running[0])} or None}

        return enveloped(call)()

    def clear_index(self) -> dict:
        return enveloped(lambda: {"message": "cleared", "cleared": self.store.clear()})()

    def cancel_task(self, key: str) -> dict:
        return {"status": self.tasks.cancel(key), "task_id": key}

    def engine(self, codebase_path: str | None = None) -> Engine:
        """Searches over the newest snapshot; where a path is given and settings say so, brought up to date before."""
        if codebase_path is not None and self.store.settings.sync_on_search and self.store.needs_reindexing(codebase_path):
            self.store.index(codebase_path)
        return Engine(self.store.chunks(), self.store.embed, self.store.bm25(), self.store.settings.quantize, self.store.near)

    def search_code(self, query: str, language: str | None = None, max_results: int = 10, similarity_threshold: float = 0.7, codebase_path: str | None = None) -> dict:
        return enveloped(lambda: self.engine(codebase_path).search_code(query, language, max_results, similarity_threshold))()
