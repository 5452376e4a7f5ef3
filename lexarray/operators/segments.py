"""A store that grows by segments: a change writes its own rows and postings, and never those of the rest.

A commit writes a segment (tables of rows with a path, and the inverted index of the texts among them) and tombstones of the
paths it removes or replaces; a manifest names what is current. Readers leave out rows that a later commit has buried. Segments
of like size are merged, so that there are only logarithmically many; merging reads terms, not texts. One writer commits at
a time: a manifest's file can be created once only, so the second of two writers fails and has to start over.

Postings lie in blocks, one for a term and a range of documents, with the largest frequency and the smallest length in it; a row
holds a term's blocks, up to 64. They are dealt to files packed, as most terms of most corpora are rare: a row a block would be
shuffled and sorted at many times its size.
No document of a range can score above the sum of its terms' bounds, so a search reads the ranges with the largest bounds
first and then only those whose bound reaches the n-th best score found. Documents are scored in full, so rows are exact.
"""

from __future__ import annotations

import json
import math
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lexarray.functions.tokenise import counted
from lexarray.operators.bm25 import K1, B, query_terms

#: So many segments of like size become one.
FANOUT = 4
#: Documents in a range, as a power of two.
RANGE_BITS = 6
#: Ranges that a search names in its filter, so that files skip the others; more are joined.
NAMED = 512
#: Room for rounding errors of bounds and scores.
_ROOM = 1e-9

_DOCS = "doc long, path string, language string, dl int, terms array<string>, tfs array<int>, range long"
_POSTINGS = "term string, language string, n int, range long, last long, ranges array<long>, ns array<int>, max_tfs array<int>, min_dls array<int>, docs array<long>, tfs array<int>, dls array<int>"
_DEAD = "doc long, dl int, terms array<string>, before long"
#: Blocks of a row.
_ROW = 64
#: Postings of a file, about, and those dealt together; terms drawn to set the bounds of files, which change no result.
_FILE, _AT_ONCE, _DRAWN = 1 << 20, 1 << 21, 1 << 16
#: Intervals of ranges that a filter names.
_INTERVALS = 32
_EMPTY = {"version": 0, "segments": [], "tombstones": [], "docs": 0, "length": 0, "marks": {}}


def _dealt(batches: Iterator[pa.RecordBatch], bounds: list[str]) -> Iterator[pa.RecordBatch]:
    """The postings of documents by part, packed: parts lie between bounds, and a term that is a bound more than once, as many
    documents hold it, is spread over parts by ranges of documents."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("terms")).fill_null(0).to_numpy(zero_copy_only=False))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + _AT_ONCE, side="right")))
            column = {n: batch.column(n).slice(a, b - a) for n in batch.schema.names}
            a = b
            owner = np.repeat(np.arange(len(column["doc"])), pc.list_value_length(column["terms"]).fill_null(0).to_numpy(zero_copy_only=False))
            if not len(owner):
                continue
            terms = column["terms"].flatten().dictionary_encode()
            known, code = terms.dictionary.to_pylist(), terms.indices.to_numpy()
            low, high = (np.array([f(bounds, t) for t in known])[code] for f in (bisect_left, bisect_right))
            part = low + column["range"].to_numpy()[owner] % (high - low + 1)
            order = np.argsort(part, kind="stable")
            part, of = part[order], pa.array(owner[order])
            own = [terms.dictionary.take(pa.array(code[order])), *(column[n].take(of) for n in ("language", "range", "doc")), column["tfs"].flatten().take(pa.array(order)), column["dl"].take(of)]
            rows = pa.RecordBatch.from_arrays(own, ["term", "language", "range", "doc", "tf", "dl"])
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            packed = []
            for x, y in zip(at, np.append(at[1:], len(part)), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                    out.write_batch(rows.slice(x, y - x))
                packed.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(packed, pa.binary())], ["part", "packed"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of a part as blocks, those of a term and language in one row, or in rows of _ROW blocks, sorted by term."""
    held = [pa.ipc.open_stream(x.as_buffer()).read_all() for batch in batches for x in batch.column(1)]
    if not held:
        return
    rows = pa.concat_tables(held).combine_chunks().to_batches()[0]
    held.clear()
    terms, language = rows.column(0).dictionary_encode(), rows.column(1).dictionary_encode("encode")
    rank = np.empty(len(terms.dictionary), np.int64)
    rank[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(rank))
    code, tongue, place = terms.indices.to_numpy(), language.indices.to_numpy(), rows.column(2).to_numpy()
    key = rank[code] * len(language.dictionary) + tongue
    order = np.lexsort((place, key))
    key, place, doc, tf, dl = key[order], place[order], *(rows.column(n).to_numpy()[order] for n in (3, 4, 5))
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])))
    n = np.diff(np.append(first, len(key)))
    new = np.append(True, key[first][1:] != key[first][:-1])
    since = np.arange(len(first)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    row = np.flatnonzero(since % _ROW == 0)
    ends = np.append(row[1:], len(first)) - 1
    of = order[first[row]]
    blocks, postings = pa.array(np.append(row, len(first)), pa.int32()), pa.array(np.append(first[row], len(key)), pa.int32())
    lists = [pa.ListArray.from_arrays(blocks, pa.array(x)) for x in (place[first], n.astype(np.int32), np.maximum.reduceat(tf, first), np.minimum.reduceat(dl, first))]
    lists += [pa.ListArray.from_arrays(postings, pa.array(x)) for x in (doc, tf, dl)]
    head = [terms.dictionary.take(pa.array(code[of])), language.dictionary.take(pa.array(tongue[of])), pa.array(np.add.reduceat(n, row).astype(np.int32)), pa.array(place[first[row]]), pa.array(place[first[ends]])]
    yield pa.RecordBatch.from_arrays([*head, *lists], ["term", "language", "n", "range", "last", "ranges", "ns", "max_tfs", "min_dls", "docs", "tfs", "dls"])


class Segments:
    """Tables by name, each with a column path, and texts (doc, path, language, content) in a folder all executors share."""

    def __init__(self, spark: SparkSession, folder: str, partitions: dict[str, str] | None = None) -> None:
        """partitions: the column by which folders of a table are split."""
        self.spark, self.folder, self.partitions = spark, folder, partitions or {}

    # files
    def _at(self, name: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def size(self, name: str = "") -> int:
        """Bytes of a folder of the store."""
        path, fs = self._at(name) if name else self._at(".")
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def clear(self) -> None:
        path, fs = self._at(".")
        fs.delete(path, True)

    def _versions(self) -> list[str]:
        path, fs = self._at("manifest")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def manifest(self) -> dict:
        """The current segments and tombstones, live documents and their length; of a store without commits an empty one."""
        names = self._versions()
        return self._manifest(names[-1]) if names else json.loads(json.dumps(_EMPTY))

    def _manifest(self, name: str) -> dict:
        path, fs = self._at(f"manifest/{name}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, m: dict) -> None:
        path, fs = self._at(f"manifest/{m['version']:012}.json")
        stream = fs.create(path, False)  # fails where another writer was first
        stream.write(bytearray(json.dumps(m).encode()))
        stream.close()

    def _sweep(self) -> None:
        """Folders that neither the current manifest nor the one before it names are deleted, and older manifests. marks may name
        more folders to keep, as `folders`."""
        names = self._versions()
        named = {x for v in names[-2:] for m in [self._manifest(v)] for x in [*(s["name"] for s in m["segments"]), *m["tombstones"], *m["marks"].get("folders", [])]}
        root, fs = self._at(".")
        for x in fs.listStatus(root):
            name = x.getPath().getName()
            if name != "manifest" and name not in named:
                fs.delete(x.getPath(), True)
        for v in names[:-2]:
            path, _ = self._at(f"manifest/{v}")
            fs.delete(path, False)

    # reading
    def _union(self, m: dict, name: str, schema: str, segments: list[dict] | None = None) -> DataFrame:
        """Rows of a table in all segments with seg, their segment's number, the dead ones among them."""
        frames = [self.spark.read.schema(schema).parquet(f"{self.folder}/{s['name']}/{name}").withColumn("seg", F.lit(s["number"]).cast("long")) for s in (m["segments"] if segments is None else segments) if name in s["tables"]]
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], f"{schema}, seg long")

    def _buried(self, m: dict, name: str, schema: str) -> DataFrame | None:
        places = [f"{self.folder}/{t}/{name}" for t in m["tombstones"]]
        return self.spark.read.schema(schema).parquet(*places) if places else None

    def _live(self, m: dict, rows: DataFrame, key: str = "path") -> DataFrame:
        dead = self._buried(m, "paths", "path string, before long") if key == "path" else self._buried(m, "dead", _DEAD)
        if dead is None:
            return rows
        dead = dead.select(F.col(key).alias("_key"), "before")
        return rows.join(dead, (F.col(key) == F.col("_key")) & (F.col("seg") < F.col("before")), "left_anti")

    def read(self, name: str, schema: str, m: dict | None = None) -> DataFrame:
        """The live rows of a table."""
        m = m or self.manifest()
        return self._live(m, self._union(m, name, schema)).drop("seg")

    def documents(self) -> DataFrame:
        """doc, path, language, dl, terms and tfs of the live documents."""
        return self.read("docs", _DOCS).drop("range")

    def postings(self) -> DataFrame:
        """(term, doc, language, tf, dl) of the live documents."""
        m = self.manifest()
        return self._live(m, self._opened(self._union(m, "postings", _POSTINGS)), "doc").drop("seg")

    def stats(self) -> DataFrame:
        """n_docs, avg_len and n_terms, without reading a document."""
        m = self.manifest()
        terms = self._frequencies(m, self._union(m, "postings", _POSTINGS)).where("df > 0").agg(F.count("*").alias("n_terms"))
        return terms.select(F.lit(m["docs"]).cast("long").alias("n_docs"), F.lit(round(m["length"] / m["docs"], 6) if m["docs"] else None).cast("double").alias("avg_len"), "n_terms")

    # writing
    def add(self, tables: dict[str, DataFrame] | None = None, texts: DataFrame | None = None, removed: DataFrame | None = None, marks: Callable[[int], dict] = lambda added: {}) -> dict:
        """Commits rows and texts; removed: paths whose rows so far go. marks: values to keep in the manifest, given how
        many documents were added.

        Returns the bytes written for the change and for merging, and how many documents were added and removed.
        """
        m = self.manifest()
        number = m["version"] + 1
        out = {"docs_added": 0, "docs_removed": 0, "bytes": 0, "merged_bytes": 0}
        if removed is not None and m["segments"]:
            name = f"tomb-{number}-{uuid.uuid4().hex[:8]}"
            out["docs_removed"], length = self._bury(m, removed, number, name)
            m["tombstones"].append(name)
            m["docs"] -= out["docs_removed"]
            m["length"] -= length
            out["bytes"] += self.size(name)
        if tables or texts is not None:
            segment = self._written(number, tables or {}, texts)
            m["segments"].append(segment)
            m["docs"] += segment["docs"]
            m["length"] += segment["length"]
            out["docs_added"] = segment["docs"]
            out["bytes"] += self.size(segment["name"])
        out["merged_bytes"] = self._merge(m)
        self._publish(m | {"version": number, "marks": m["marks"] | marks(out["docs_added"])})
        self._sweep()
        return out | {"segments": len(m["segments"])}

    def _bury(self, m: dict, removed: DataFrame, number: int, name: str) -> tuple[int, int]:
        """Tombstones of paths, of their live documents, and how many of these hold each term."""
        at = f"{self.folder}/{name}"
        removed.select("path", F.lit(number).cast("long").alias("before")).distinct().write.parquet(f"{at}/paths")
        paths = self.spark.read.schema("path string, before long").parquet(f"{at}/paths")
        seen = Observation()
        dead = self._live(m, self._union(m, "docs", _DOCS)).join(paths, "path").select("doc", "dl", "terms", "before")
        dead.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length")).write.parquet(f"{at}/dead")
        gone = self.spark.read.schema(_DEAD).parquet(f"{at}/dead")
        gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).write.parquet(f"{at}/terms")
        return seen.get["n"], seen.get["length"]

    def _written(self, number: int, tables: dict[str, DataFrame], texts: DataFrame | None) -> dict:
        name, docs = f"seg-{number}-{uuid.uuid4().hex[:8]}", None
        for table, rows in tables.items():
            self._write(rows, name, table)
        if texts is not None:
            found = texts.select("doc", "path", "language", counted(F.col("content")).alias("c")).select("doc", "path", "language", "c.dl", "c.terms", "c.tfs")
            docs = self._documents(name, found)
        return {"name": name, "number": number, "tables": [*tables, *(["docs", "postings"] if docs else [])], "docs": docs["n"] if docs else 0, "length": docs["length"] if docs else 0}

    def _write(self, rows: DataFrame, segment: str, table: str) -> None:
        by = self.partitions.get(table)
        (rows.write.partitionBy(by) if by else rows.write).parquet(f"{self.folder}/{segment}/{table}")

    def _documents(self, name: str, found: DataFrame) -> dict:
        """Writes documents with their counts, and from these the postings."""
        seen = Observation()
        numbered = found.withColumn("range", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS))
        numbered.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("length"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).write.parquet(f"{self.folder}/{name}/docs")
        docs = self.spark.read.schema(_DOCS).parquet(f"{self.folder}/{name}/docs")
        parts, bounds = max(1, math.ceil(seen.get["postings"] / _FILE)), []
        if parts > 1:
            each = docs.select("doc", F.explode("terms").alias("term"))
            drawn = sorted(r["term"] for r in each.where(F.pmod(F.xxhash64("doc", "term"), F.lit(seen.get["postings"])) < _DRAWN).select("term").collect())
            bounds = [drawn[len(drawn) * k // parts] for k in range(1, parts)]
        packed = docs.mapInArrow(lambda batches: _dealt(batches, bounds), "part int, packed binary").repartitionById(parts, "part")
        packed.mapInArrow(_blocks, _POSTINGS).write.option("compression", "zstd").parquet(f"{self.folder}/{name}/postings")
        return seen.get

    def _merge(self, m: dict) -> int:
        """Segments of one size class become one, as long as there are FANOUT of one; returns the bytes written."""
        written = 0
        while True:
            classes: dict[int, list[dict]] = {}
            for s in m["segments"]:
                classes.setdefault(int(math.log(max(1, s["docs"]), FANOUT)), []).append(s)
            full = next((x for x in classes.values() if len(x) >= FANOUT), None)
            if full is None:
                break
            number = max(s["number"] for s in full)
            name = f"seg-{number}-{uuid.uuid4().hex[:8]}"
            for table in sorted({t for s in full for t in s["tables"]} - {"docs", "postings"}):
                first = next(s for s in full if table in s["tables"])
                schema = self.spark.read.parquet(f"{self.folder}/{first['name']}/{table}").schema
                rows = self._live(m, self._union(m, table, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), full)).drop("seg")
                self._write(rows, name, table)
            docs = None
            if any("docs" in s["tables"] for s in full):
                docs = self._documents(name, self._live(m, self._union(m, "docs", _DOCS, full)).drop("seg", "range"))
            m["segments"] = [s for s in m["segments"] if s not in full] + [{"name": name, "number": number, "tables": sorted({t for s in full for t in s["tables"]}), "docs": docs["n"] if docs else 0, "length": docs["length"] if docs else 0}]
            written += self.size(name)
        # a tombstone of commit k buries rows of segments before k only
        oldest = min((s["number"] for s in m["segments"]), default=0)
        m["tombstones"] = [t for t in m["tombstones"] if int(t.split("-")[1]) > oldest]
        return written

    # ranking
    def _frequencies(self, m: dict, postings: DataFrame, terms: list[str] | None = None) -> DataFrame:
        """(term, df): live documents that hold a term, from counts alone."""
        of = lambda x: x if terms is None else x.where(F.col("term").isin(terms))
        counts = of(postings.select("term", "n"))
        dead = self._buried(m, "terms", "term string, n long")
        if dead is not None:
            counts = counts.unionByName(of(dead).select("term", (-F.col("n")).alias("n")))
        return counts.groupBy("term").agg(F.sum("n").alias("df"))

    @staticmethod
    def _opened(rows: DataFrame, placed: bool = False) -> DataFrame:
        """term, language, seg, doc, tf and dl of each posting; range too if placed."""
        place = F.flatten(F.transform(F.arrays_zip("ranges", "ns"), lambda x: F.array_repeat(x["ranges"], x["ns"])))
        lists = [F.col(x) for x in ("docs", "tfs", "dls")] + [place.alias("places")] * placed
        each = rows.select("term", "language", "seg", F.explode(F.arrays_zip(*lists)).alias("p"))
        return each.select("term", "language", "seg", F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), *[F.col("p.places").alias("range")] * placed)

    def search(self, query: str, n: int = 50, language: str | None = None, k1: float = K1, b: float = B, report: dict | None = None) -> DataFrame:
        """(doc, score) of the n best live documents, as bm25.search() ranks them; report gets how many ranges of documents
        hold a term of the query, and how many of these are read."""
        m, terms = self.manifest(), query_terms(query)
        none = self.spark.createDataFrame([], "doc long, score double")
        if not terms or not m["docs"]:
            return none
        blocks = self._union(m, "postings", _POSTINGS)
        known = {r["term"]: r["df"] for r in self._frequencies(m, blocks, sorted(terms)).collect()}  # the query's terms
        weight = {t: terms[t] * math.log((m["docs"] - df + 0.5) / (df + 0.5) + 1) for t, df in known.items() if df > 0}
        if not weight:
            return none
        average = m["length"] / m["docs"]
        weights = F.create_map(*[F.lit(x) for t in sorted(weight) for x in (t, weight[t])])[F.col("term")]

        def part(tf: str, dl: str) -> Column:
            return weights * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl) / average))

        blocks = blocks.where(F.col("term").isin(sorted(weight)))
        if language is not None:
            blocks = blocks.where(F.col("language") == language)
        place = ["seg", "range"]
        each = blocks.select("term", "seg", F.explode(F.arrays_zip("ranges", "max_tfs", "min_dls")).alias("b"))
        each = each.select("term", "seg", F.col("b.ranges").alias("range"), F.col("b.max_tfs").alias("max_tf"), F.col("b.min_dls").alias("min_dl"))
        bounds = each.groupBy(*place).agg(F.sum(part("max_tf", "min_dl")).alias("bound"))  # reads no document
        best = lambda x: self._live(m, x, "doc").groupBy("doc").agg(F.sum(part("tf", "dl")).alias("score")).orderBy(F.desc("score"), "doc").limit(n)
        top = bounds.orderBy(F.desc("bound"), *place).limit(NAMED + 1).collect()
        found = best(self._of(blocks, top[:n])).collect()
        least = found[-1]["score"] * (1 - _ROOM) if len(found) == n else 0.0
        named = [r for r in top if r["bound"] >= least]
        if report is not None:
            report |= {"ranges": bounds.count(), "read": bounds.where(F.col("bound") >= least).count()}
        if len(named) <= min(n, NAMED):  # these are read already
            return self.spark.createDataFrame(found, "doc long, score double").orderBy(F.desc("score"), "doc")
        return best(self._of(blocks, named) if len(named) <= NAMED else self._opened(blocks, placed=True).join(bounds.where(F.col("bound") >= least).select(*place), place, "left_semi"))

    @classmethod
    def _of(cls, blocks: DataFrame, rows: list) -> DataFrame:
        """The postings of some ranges, by a filter that files can skip by: intervals between the widest gaps."""
        by: dict[int, list[int]] = {}
        for r in rows:
            by.setdefault(r["seg"], []).append(r["range"])
        either = lambda tests: reduce(lambda x, y: x | y, tests, F.lit(False))
        near = []
        for s, ranges in sorted(by.items()):
            own = np.unique(ranges)
            cuts = np.sort(np.argsort(-np.diff(own), kind="stable")[: _INTERVALS - 1]) + 1
            near += [(F.col("seg") == s) & (F.col("range") <= int(x[-1])) & (F.col("last") >= int(x[0])) for x in np.split(own, cuts)]
        exact = [(F.col("seg") == s) & F.col("range").isin(ranges) for s, ranges in sorted(by.items())]
        return cls._opened(blocks.where(either(near)), placed=True).where(either(exact))
