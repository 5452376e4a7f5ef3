"""Source trees as tables: scanning, languages, exclusions, git's view of changes."""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType

#: Languages by file extension.
LANGUAGES = {
    "python": "py", "javascript": "js jsx", "typescript": "ts tsx", "go": "go", "rust": "rs", "java": "java", "c": "c h", "cpp": "cpp cc cxx hpp",
    "csharp": "cs", "php": "php", "ruby": "rb", "html": "html htm", "css": "css", "json": "json", "yaml": "yaml yml",
}
#: What is left out of every scan.
EXCLUDED = "*.venv* */.venv/* */venv/* */env/* */__pycache__/* */.pytest_cache/* */.mypy_cache/* */.git/* */node_modules/* */.tox/* */.nox/* */build/* */dist/* */.coverage/* */htmlcov/* */.idea/* */.vscode/* */logs/*".split()
MAX_FILE_MB = 10
#: Extensions that other steps know: detection has no .htm, the extractor few, the updater some more.
DETECTED = LANGUAGES | {"html": "html"}
EXTRACTED = {k: LANGUAGES[k] for k in ("python", "javascript", "typescript", "go", "rust", "java")}
UPDATED = EXTRACTED | {k: LANGUAGES[k] for k in ("c", "cpp")}
#: What the updater leaves out, by absolute path only.
UPDATE_EXCLUDED = "**/.git/** **/node_modules/** **/__pycache__/** **/venv/** **/env/** **/.env **/build/** **/dist/** **/*.log **/*.tmp **/coverage/**".split()


def language_of(path: Column, known: dict[str, str] = LANGUAGES) -> Column:
    """By the extension in small letters; `text` for others."""
    pairs = [F.lit(x) for lang, ends in known.items() for e in ends.split() for x in (e, lang)]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))], F.lit("text"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob whose * also crosses /."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob) + "$"


def excluded(path: Column, globs: list[str], absolute: bool = False) -> Column:
    """Whether a glob fits the path, with or without its leading slash; absolute: the path as it is only."""
    tests = [p.rlike(glob_pattern(g)) for g in globs for p in ([path] if absolute else [path, F.regexp_replace(path, "^/", "")])]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _read(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """The files under root, or those of some names that are there."""
    reader = spark.read.format("binaryFile")
    if names is None:
        files = reader.option("recursiveFileLookup", "true").load(root)
    else:
        there = [x for x in names if os.path.isfile(x)]
        files = reader.load(there) if there else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


@F.pandas_udf(StringType())
def _decoded(contents):  # noqa: ANN001, ANN202
    return contents.map(lambda x: bytes(x).decode("utf-8", "ignore"))


def _listed(files: DataFrame, language: Column) -> DataFrame:
    """path, length, modified, language, content (text without undecodable bytes) and its SHA-256."""
    out = files.select("path", "length", "modified", language.alias("language"), _decoded("content").alias("content"))
    return out.withColumn("file_hash", F.sha2(F.col("content").cast("binary"), 256))


def discover(spark: SparkSession, root: str, languages: list[str] | None = None, exclude: tuple[str, ...] = (), max_mb: float = MAX_FILE_MB, names: list[str] | None = None) -> DataFrame:
    """The source files under root, or of some absolute names, as _listed() gives them.

    Extensions are matched as written; unknown language names add nothing; files of max_mb or more are left out.
    """
    wanted = [e for name in (languages or LANGUAGES) for e in LANGUAGES.get(name, "").split()]
    own = (F.col("length") < max_mb * 1048576) & F.regexp_extract("path", r"\.([^./]+)$", 1).isin(wanted) & ~excluded(F.col("path"), [*EXCLUDED, *exclude])
    return _listed(_read(spark, root, names).where(own), language_of(F.col("path"), DETECTED))


def discover_updates(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The files under root that the updater tracks: a language by the extension in any case, its own exclusions."""
    language = language_of(F.col("path"), UPDATED)
    return _listed(_read(spark, root).where((language != "text") & ~excluded(F.col("path"), [*UPDATE_EXCLUDED, *exclude], absolute=True)), language)


def _git(root: str, *args: str) -> str | None:
    """What a git command says in a folder; None where it fails or there is no git."""
    try:
        out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    except OSError:
        return None
    return out.stdout if out.returncode == 0 else None


def in_work_tree(root: str) -> bool:
    return (_git(root, "rev-parse", "--is-inside-work-tree") or "").strip() == "true"


def git_commit(root: str) -> str | None:
    return (_git(root, "rev-parse", "--verify", "-q", "HEAD") or "").strip() or None


def _statuses(root: str) -> Iterator[tuple[str, str, str]]:
    """(status, code, path) of what git reports below a folder, paths below that folder. A rename is a deletion and a new file,
    a copy a new file; what a rename brings from or takes to outside the folder counts on its own side only."""
    prefix = (_git(root, "rev-parse", "--show-prefix") or "").strip("\n")
    out = _git(root, "-c", "status.renames=copies", "status", "--porcelain=v1", "-z", "--untracked-files=all", "--", ".")
    if out is None:
        raise ValueError(f"git reports nothing on {root}")
    entries = iter(out.split("\0"))
    for e in entries:
        if not e:
            continue
        code, path = e[:2], e[3:]
        found = [("deleted" if "D" in code else "new" if code == "??" or "A" in code or "R" in code or "C" in code else "modified", path)]
        if "R" in code or "C" in code:
            before = next(entries)
            found += [("deleted", before)] * ("R" in code)
        yield from ((status, code, x[len(prefix) :]) for status, x in found if x.startswith(prefix))


class GitStatus(DataSource):
    """spark.read.format("git_status").load(folder): (status, code, path) of a work tree's changes below a folder."""

    @classmethod
    def name(cls) -> str:
        return "git_status"

    def schema(self) -> str:
        return "status string, code string, path string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _GitReader(self.options["path"])


class _GitReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # git answers for the whole folder at once

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str, str]]:
        yield from _statuses(self.root)


def git_changes(spark: SparkSession, root: str) -> DataFrame:
    """(status, path) of the source files that git reports as new, modified or deleted below a folder, paths below it."""
    spark.dataSource.register(GitStatus)
    return spark.read.format("git_status").load(root).where(language_of(F.col("path"), UPDATED) != "text").select("status", "path")


def git_names(root: str, commit: str | None) -> list[str] | None:
    """The files below a folder that may differ from a commit's: changed since, changed in the work tree, or untracked;
    None where git cannot tell."""
    if commit is None:
        return None
    tracked = _git(root, "diff", "--name-only", "--relative", "--no-renames", "-z", commit, "--", ".")
    untracked = _git(root, "ls-files", "--others", "-z", "--", ".")
    return None if tracked is None or untracked is None else sorted({x for x in (tracked + untracked).split("\0") if x})
