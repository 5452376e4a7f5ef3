"""Nearest neighbours, keyword and metadata search over the chunk table."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarray.functions.text import json_array, like
from lexarray.functions.vector import distance

FUNCTION_TYPES = ("function_definition", "async_function_definition", "method_definition")
CLASS_TYPES = ("class_definition", "class_declaration", "interface_declaration")


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", threshold: float | None = None, prefilter: Column | None = None, postfilter: Column | None = None, key: str = "vec_id") -> DataFrame:
    """The k rows nearest to a vector, ties by key. A postfilter applies to the k rows found, a prefilter before."""
    rows = vectors if prefilter is None else vectors.where(prefilter)
    rows = rows.withColumn("distance", distance(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]), metric))
    if threshold is not None:
        rows = rows.where(F.col("distance") <= threshold)
    rows = rows.orderBy(F.asc_nulls_last("distance"), key).limit(k)
    return rows if postfilter is None else rows.where(postfilter)


def _exact(q: np.ndarray, v: np.ndarray, metric: str, units: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """distance() of rows of q and v, summed in the same order, so that equal vectors have equal distances."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += (q[:, j] - v[:, j]) ** 2 if metric == "l2" else q[:, j] * v[:, j]
    if metric == "l2":
        return np.sqrt(total)
    if metric == "dot":
        return -total
    size = units[0] * units[1]
    return np.where(size == 0, np.inf, 1.0 - np.divide(total, size, out=np.zeros_like(total), where=size != 0))


def _norms(v: np.ndarray) -> np.ndarray:
    total = np.zeros(len(v))
    for j in range(v.shape[1]):
        total += v[:, j] * v[:, j]
    return np.sqrt(total)


class _Nearest:
    """The k nearest of the rows seen so far for some queries of one dimension."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str) -> None:
        self.ids, self.q, self.norm, self.k, self.metric = ids, q, _norms(q), k, metric
        self.best, self.keys, self.there = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64), np.zeros((len(ids), k), bool)

    def add(self, own: np.ndarray, v: np.ndarray) -> None:
        # of equal vectors the k + 1 smallest keys are enough: one of them can be the query
        order = np.lexsort((own, np.unique(v.view([("", v.dtype)] * v.shape[1]).ravel(), return_inverse=True)[1]))
        own, v = own[order], np.ascontiguousarray(v[order])
        new = np.append(True, (v[1:] != v[:-1]).any(axis=1))
        first = np.flatnonzero(new)
        few = np.arange(len(own)) - first[np.cumsum(new) - 1] <= self.k
        own, v = own[few], v[few]
        norm = _norms(v)
        for a in range(0, len(self.q), 256):
            for b in range(0, len(v), 4096):
                self._block(slice(a, a + 256), own[b : b + 4096], v[b : b + 4096], norm[b : b + 4096])

    def _block(self, some: slice, own: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        q, q_norm, ids = self.q[some], self.norm[some], self.ids[some]
        near, room = q @ v.T, np.full(len(q), 1e-9)
        if self.metric == "l2":
            near = q_norm[:, None] ** 2 + norm**2 - 2 * near  # squares
            room = room * (1 + q_norm + norm.max()) ** 2
        elif self.metric == "dot":
            near = -near
            room = room * (1 + q_norm * norm.max())
        else:
            size = q_norm[:, None] * norm
            near = np.where(size == 0, np.inf, 1.0 - np.divide(near, size, out=np.zeros_like(near), where=size != 0))
        other = ids[:, None] != own
        near = np.where(other, near, np.inf)
        bound = self.best[some, -1] ** 2 if self.metric == "l2" else self.best[some, -1]
        if len(own) > self.k:
            bound = np.minimum(bound, np.partition(near, self.k - 1, axis=1)[:, self.k - 1])
        row, at = np.nonzero((near <= (bound + room)[:, None]) & other)
        for c in range(0, len(row), 1 << 16):
            self._merge(some.start, row[c : c + (1 << 16)], own[at[c : c + (1 << 16)]], v[at[c : c + (1 << 16)]], norm[at[c : c + (1 << 16)]])

    def _merge(self, start: int, row: np.ndarray, own: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        found = _exact(self.q[start + row], v, self.metric, (self.norm[start + row], norm))
        held = np.unique(start + row)
        kept_row, kept_at = np.nonzero(self.there[held])
        rows = np.append(held[kept_row], start + row)
        dist = np.append(self.best[held][kept_row, kept_at], found)
        keys = np.append(self.keys[held][kept_row, kept_at], own)
        order = np.lexsort((keys, dist, rows))
        rows, dist, keys = rows[order], dist[order], keys[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        top = place < self.k
        at = rows[top], place[top]
        self.best[at], self.keys[at], self.there[at] = dist[top], keys[top], True

    def result(self) -> pa.RecordBatch:
        row, _ = np.nonzero(self.there)
        distance = self.best[self.there]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[row]), pa.array(self.keys[self.there]), pa.array(distance, mask=np.isinf(distance))], ["query_id", "key", "distance"])


def _nearest_of_tasks(k: int, metric: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For rows (task, kind, id, v) in order of task and kind, queries first: k rows of each query of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, nearest = None, [], None
        for batch in batches:
            task, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.append(True, (task[1:] != task[:-1]) | (kind[1:] != kind[:-1])))
            for a, b in zip(edge, np.append(edge[1:], len(task)), strict=True):
                if task[a] != at:
                    if nearest is not None:
                        yield nearest.result()
                    at, asked, nearest = task[a], [], None
                part = batch.slice(a, b - a)
                rows = part.column(2).to_numpy(), part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if kind[a] == 0:
                    asked.append(rows)
                elif asked:
                    nearest = nearest or _Nearest(*map(np.concatenate, zip(*asked, strict=True)), k, metric)
                    nearest.add(*rows)
        if nearest is not None:
            yield nearest.result()

    return run


def knn_of(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", key: str = "vec_id", block: int = 1 << 14) -> DataFrame:
    """The k nearest rows (query_id, key, distance, rank) of each query (query_id, q), itself left out.

    Queries go in blocks of about `block`; a block meets the vectors in as many tasks as there are shuffle partitions, and a
    task holds one block and a batch of vectors. Products of matrices tell which rows can be among the k nearest; their
    distances are summed as distance() sums them. Each task keeps k rows a query before anything more is shuffled. Vectors
    of another dimension than most, with nulls or without finite components are compared one by one.
    """
    from pyspark.sql import Window

    spark = queries.sparkSession
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where("query_id is not null")
    rows = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding")).where(F.col(key).isNotNull())
    widths = rows.groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()  # a row a dimension
    width = widths["d"] if widths else 0
    whole = dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") and dict(asked.dtypes)["query_id"] in ("tinyint", "smallint", "int", "bigint")
    plain = lambda c: F.coalesce((F.size(c) == width) & F.forall(c, lambda x: F.coalesce(F.abs(x) < 1e100, F.lit(False))), F.lit(False)) & F.lit(whole)
    blocks, splits = max(1, -(-asked.count() // block)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) * splits
    every = asked.where(plain("q")).select(F.explode(F.sequence(first, first + splits - 1)).alias("task"), F.lit(0).alias("kind"), F.col("query_id").cast("long").alias("id"), F.col("q").alias("v"))
    own = F.pmod(F.xxhash64(key, "embedding"), F.lit(splits))
    met = rows.where(plain("embedding")).select(F.explode(F.sequence(own, own + (blocks - 1) * splits, F.lit(splits).cast("long"))).alias("task"), F.lit(1).alias("kind"), F.col(key).cast("long").alias("id"), F.col("embedding").alias("v"))
    dealt = every.unionByName(met).repartition(blocks * splits, "task").sortWithinPartitions("task", "kind")
    found = dealt.mapInArrow(_nearest_of_tasks(k, metric), "query_id long, key long, distance double").withColumnRenamed("key", key)

    def each(q: DataFrame, v: DataFrame) -> DataFrame:
        return q.join(v, F.col(key) != F.col("query_id")).select("query_id", key, distance(F.col("embedding"), F.col("q"), metric).alias("distance"))

    odd = each(asked.where(~plain("q")), rows).unionByName(each(asked.where(plain("q")), rows.where(~plain("embedding"))))
    kinds = (dict(asked.dtypes)["query_id"], dict(rows.dtypes)[key])
    found = found.select(F.col("query_id").cast(kinds[0]), F.col(key).cast(kinds[1]), "distance").unionByName(odd)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def keyword_search(chunks: DataFrame, query: str, language: str | None = None, n: int = 50) -> DataFrame:
    rows = chunks.where(like(F.col("content"), query))
    if language is not None:
        rows = rows.where(F.col("language") == language)
    return rows.orderBy("rowid").limit(n)


def search_by_type(chunks: DataFrame, kind: str, language: str | None = None, n: int = 20, in_text: bool = False) -> DataFrame:
    """Chunks of a semantic type; with in_text their content must also hold the type's name."""
    rows = keyword_search(chunks, kind, language) if in_text else chunks if language is None else chunks.where(F.col("language") == language)
    return rows.where(F.col("semantic_type") == kind).orderBy("rowid").limit(n)


def _all(*terms: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [t for t in terms if t is not None], F.lit(True))


def search_functions(chunks: DataFrame, name: str | None = None, returns: str | None = None, parameters: tuple[str, ...] = (), language: str | None = None, n: int = 50, types: tuple[str, ...] = FUNCTION_TYPES) -> DataFrame:
    test = _all(
        F.col("semantic_type").isin(*types),
        like(F.col("function_name"), name) if name else None,
        like(F.col("return_type"), returns) if returns else None,
        *[like(json_array(F.col("parameter_types")), p) for p in parameters],
        F.col("language") == language if language else None,
    )
    return chunks.where(test).orderBy(F.asc_nulls_first("complexity_score"), "rowid").limit(n)


def search_classes(chunks: DataFrame, name: str | None = None, inherits: str | None = None, implements: str | None = None, n: int = 50, types: tuple[str, ...] = CLASS_TYPES) -> DataFrame:
    test = _all(
        F.col("semantic_type").isin(*types),
        like(F.col("class_name"), name) if name else None,
        like(json_array(F.col("inheritance_chain")), inherits) if inherits else None,
        like(json_array(F.col("interfaces")), implements) if implements else None,
    )
    return chunks.where(test).orderBy("rowid").limit(n)


def search_imports(chunks: DataFrame, module: str | None = None, uses: str | None = None, language: str | None = None, n: int = 50) -> DataFrame:
    test = _all(
        (F.coalesce(like(json_array(F.col("import_statements")), module), F.lit(False)) | F.coalesce(like(json_array(F.col("dependencies")), module), F.lit(False))) if module else None,
        like(F.col("content"), uses) if uses else None,
        F.col("language") == language if language else None,
    )
    return chunks.where(test).orderBy("rowid").limit(n)


def general_metadata(chunks: DataFrame, query: str, n: int = 50) -> DataFrame:
    """Rows with the query in any of six fields; function names come first, then classes, signatures, the rest."""
    hit = lambda c: F.coalesce(like(F.col(c), query), F.lit(False))
    fields = ("function_name", "class_name", "function_signature", "docstring", "return_type", "content")
    rank = F.when(hit("function_name"), 1).when(hit("class_name"), 2).when(hit("function_signature"), 3).otherwise(4)
    return chunks.where(reduce(lambda a, b: a | b, map(hit, fields))).withColumn("field_rank", rank).orderBy("field_rank", "rowid").limit(n)


def complexity_range(chunks: DataFrame, least: int | None = None, most: int | None = None, language: str | None = None, n: int = 50) -> DataFrame:
    c = F.col("complexity_score")
    test = _all(c.isNotNull(), c >= least if least is not None else None, c <= most if most is not None else None, F.col("language") == language if language else None)
    return chunks.where(test).orderBy(F.desc_nulls_last("complexity_score"), "rowid").limit(n)


def signature_tokens(signature: str) -> list[str]:
    #: Words that say nothing about a signature.
    stop = {"def", "function", "async", "public", "private", "static", "void", "const", "let", "var"}
    return [t for t in re.sub(r"[(),\[\]{}<>]", " ", signature.lower()).split() if t not in stop and len(t) > 2]


def similar_signatures(chunks: DataFrame, signature: str, n: int = 50, types: tuple[str, ...] = FUNCTION_TYPES) -> DataFrame:
    rows = chunks.where(F.col("semantic_type").isin(*types))
    found = signature_tokens(signature)[:3]
    if found:
        rows = rows.where(reduce(lambda a, b: a | b, [like(F.col("function_signature"), t) for t in found]))
    return rows.orderBy("rowid").limit(n)


#: Patterns that route a metadata query, tried in order, and what they capture.
ROUTES = (
    (r"function.*return.*(\w+)", "return_type", r"return.*?(\w+)"),
    (r"function.*(\w+)", "function_name", r"function.*?(\w+)"),
    (r"class.*inherit.*(\w+)", "inherits_from", r"inherit.*?(\w+)"),
    (r"class.*(\w+)", "class_name", r"class.*?(\w+)"),
    (r"import.*(\w+)", "import_module", r"import.*?(\w+)"),
)


def route(query: str) -> tuple[str, str]:
    """(field, value) that a metadata query asks for; `general` with the query where no pattern fits."""
    q = query.lower()
    for test, field, capture in ROUTES:
        if re.search(test, q):
            return field, re.search(capture, q)[1]
    return "general", query


def _plain(pattern: str) -> str:
    """A pattern for texts of all languages and lines, as Python's own engine reads it."""
    return pattern.replace(".", r"[^\n]").replace(r"\w", r"[\p{L}\p{N}_]")


def route_of(query: Column) -> Column:
    """route() for a column of queries: a struct of field and value."""
    low = F.lower(query)
    out = F.struct(F.lit("general").alias("field"), query.alias("value"))
    for test, field, capture in reversed(ROUTES):
        found = F.struct(F.lit(field).alias("field"), F.regexp_extract(low, _plain(capture), 1).alias("value"))
        out = F.when(low.rlike(_plain(test)), found).otherwise(out)
    return out


def search_metadata(chunks: DataFrame, query: str, n: int = 50) -> DataFrame:
    field, value = route(query)
    if field == "return_type":
        return search_functions(chunks, returns=value, n=n)
    if field == "function_name":
        return search_functions(chunks, name=value, n=n)
    if field == "inherits_from":
        return search_classes(chunks, inherits=value, n=n)
    if field == "class_name":
        return search_classes(chunks, name=value, n=n)
    return search_imports(chunks, module=value, n=n) if field == "import_module" else general_metadata(chunks, query, n)


def metadata_order(query: str) -> tuple:
    """The order of search_metadata's rows."""
    field = route(query)[0]
    if field in ("return_type", "function_name"):
        return F.asc_nulls_first("complexity_score"), "rowid"
    return ("field_rank", "rowid") if field == "general" else ("rowid",)


#: Words that tell a query's type, tried in order, and words that call for the metadata leg.
QUERY_TYPES = (
    ("type_search", ("return type", "parameter type", "function type")),
    ("import_search", ("import", "require", "include")),
    ("class_search", ("class", "interface", "struct")),
    ("function_search", ("function", "method", "def ", "async def")),
    ("type_search", ("type", "parameter")),
)
METADATA_WORDS = "function method class interface type return parameter inherit extend implement decorator complexity signature".split()


def query_type(query: Column) -> Column:
    out = F.lit("general_search")
    for name, words in reversed(QUERY_TYPES):
        out = F.when(reduce(lambda a, b: a | b, [F.lower(query).contains(w) for w in words]), name).otherwise(out)
    return out


def wants_metadata(query: str) -> bool:
    return any(w in query.lower() for w in METADATA_WORDS)


#: What a query is expanded by.
EXPANSIONS = {
    "auth": ["authenticate", "login", "credential", "token", "session"],
    "user": ["account", "profile", "member", "person"],
    "data": ["information", "record", "entity", "model"],
    "save": ["store", "persist", "write", "update"],
    "get": ["fetch", "retrieve", "load", "read"],
    "delete": ["remove", "destroy", "drop"],
    "error": ["exception", "failure", "issue", "problem"],
    "config": ["configuration", "setting", "option", "parameter"],
}


def expand_query(query: str, most: int = 5) -> list[str]:
    """The query, then with one more word each, at most `most` in all."""
    low = query.lower()
    return [query, *(f"{query} {w}" for base, words in EXPANSIONS.items() if base in low for w in words if w not in low)][:most]


def expanded(query: Column, most: int = 5) -> Column:
    """expand_query() for a column of queries: an array."""
    low = F.lower(query)
    more = [F.when(low.contains(base) & ~low.contains(w), F.concat_ws(" ", query, F.lit(w))) for base, words in EXPANSIONS.items() for w in words]
    return F.slice(F.array_compact(F.array(query, *more)), 1, most)
