"""Lloyd's rounds with two trees: a cover tree over each block of vectors, built once, and a tree over the centroids of a round.

Vectors are integers, so that sums, means and distances are exact. Blocks lie as a table in the shared folder with their trees;
a round sends the centroids (their number is a parameter) to all tasks, which prune pairs of nodes by distance bounds, give
whole nodes to a centroid where no other can win, and compare what is left at the leaves exactly. Bounds are in floating point
with room for their errors, and only what is surely farther is pruned, so ties and results are those of plain comparison.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarray.llm import tables

#: Vectors of a block: its tree is built from the distances of all its pairs.
BLOCK = 1024
#: A node of so many vectors at most is a leaf.
LEAF = 8
#: Pairs of vectors compared at a time.
_PAIRS = 1 << 14
#: Components within this bound have squared distances of 64 components within a long.
_LARGEST = 1 << 27
#: Relative room for rounding errors of distances.
_ROOM = 1e-9


def quantised(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v) of the rows whose vector has dims components, all of them finite: v has floor(scale * x) of each."""
    x = F.col("x")
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x")).where(x.isNotNull() & (F.size("x") == dims) & finite)
    return rows.select("id", F.transform("x", lambda e: F.when(F.abs(e) < _LARGEST / scale, F.floor(e * scale)).otherwise(F.raise_error(F.lit("a component is beyond the range of exact distances")).cast("long"))).alias("v"))


class Tree:
    """Nodes as arrays, parents before children. A node covers the points order[first:last] within radius of a point, its
    center; children's centers are more than the node's step apart from each other. kids: first and last child."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        n = len(points)
        wide = points.astype(np.float64)
        wide -= wide[0]  # smaller numbers, smaller rounding errors
        square = (wide * wide).sum(1)
        apart = np.sqrt(np.maximum(0, square[:, None] + square[None, :] - 2 * wide @ wide.T))
        order, center, first, last, kids = np.arange(n), [0], [0], [n], [(0, 0)]
        reach = [float(apart[0].max(initial=0))]
        at = 0
        while at < len(center):
            a, b, step = first[at], last[at], reach[at] / 2
            if b - a > leaf and reach[at] > 0:
                inside, parts = order[a:b], []
                rest = np.concatenate([[center[at]], inside[inside != center[at]]])  # the node's own center covers first
                while len(rest):
                    near = apart[rest[0], rest] <= step
                    near[0] = True
                    parts.append(rest[near])
                    rest = rest[~near]
                if len(parts) == 1:  # by rounding errors only
                    parts = [parts[0][:1], parts[0][1:]]
                order[a:b] = np.concatenate(parts)
                kids[at] = (len(center), len(center) + len(parts))
                for part in parts:
                    center.append(int(part[0]))
                    first.append(a)
                    last.append(a := a + len(part))
                    kids.append((0, 0))
                    reach.append(float(apart[part[0], part].max(initial=0)))
            at += 1
        self.order, self.center, self.first, self.last, self.kids = order, np.array(center), np.array(first), np.array(last), np.array(kids).reshape(-1, 2)
        self.radius = np.zeros(len(center))
        for k in range(len(center)):  # from differences, as the distances above are not exact
            inside = points[order[self.first[k] : self.last[k]]]
            self.radius[k] = np.sqrt(((inside - points[center[k]]).astype(np.float64) ** 2).sum(1).max(initial=0)) * (1 + _ROOM)


def _packed(ids: list, points: np.ndarray) -> tuple:
    tree = Tree(points, LEAF)
    arrays = (points[tree.order], np.argsort(tree.order)[tree.center], tree.first, tree.last, tree.kids, tree.radius)
    return [ids[k] for k in tree.order], len(points), *(np.ascontiguousarray(x).tobytes() for x in arrays)


class Block:
    """A block of vectors in its tree's order."""

    def __init__(self, n: int, dims: int, points: bytes, center: bytes, first: bytes, last: bytes, kids: bytes, radius: bytes) -> None:
        self.points = np.frombuffer(points, np.int64).reshape(n, dims)
        self.center, self.first, self.last = (np.frombuffer(x, np.int64) for x in (center, first, last))
        self.kids, self.radius = np.frombuffer(kids, np.int64).reshape(-1, 2), np.frombuffer(radius)

    def assigned(self, centroids: np.ndarray, tree: Tree) -> np.ndarray:
        """The nearest centroid of each vector, the smaller number where two are equally near.

        Pairs of a node of vectors and one of centroids go down level by level. best: the distance within which each vector
        of a node surely has a centroid; a pair whose least distance is larger is dropped."""
        out = np.full(len(self.points), -1)
        hub, spread = centroids[tree.center].astype(np.float64), tree.radius
        end = tree.kids[:, 1] == 0
        one = end & ((tree.last - tree.first == 1) | (spread == 0))  # equal centroids are as one, the first of them
        lead = np.array([tree.order[a:b].min() for a, b in zip(tree.first, tree.last, strict=True)])
        leaf = self.kids[:, 1] == 0
        best = np.full(len(self.center), np.inf)
        node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        while len(node):
            d = np.sqrt(((self.points[self.center[node]].astype(np.float64) - hub[other]) ** 2).sum(1))
            around = self.radius[node] + spread[other]
            np.minimum.at(best, node, (d + self.radius[node]) * (1 + _ROOM))
            keep = d - around - _ROOM * (d + around) <= best[node]
            node, other = node[keep], other[keep]
            sure = (np.bincount(node, minlength=len(leaf))[node] == 1) & one[other]
            for a, c in zip(node[sure], lead[other[sure]], strict=True):
                out[self.first[a] : self.last[a]] = c
            node, other = node[~sure], other[~sure]
            # the wider of the two is opened; while any pair of a node opens its centroids, the node's other pairs wait, so
            # that all pairs of a node are here together
            down = ~end[other] & (leaf[node] | (spread[other] >= self.radius[node]))
            waits = np.bincount(node[down], minlength=len(leaf))[node] > 0
            whole = ~waits & leaf[node]
            ends.append((node[whole], other[whole]))
            split = ~waits & ~leaf[node]
            below = _ranges(self.kids[node[split]])
            np.minimum.at(best, below, np.repeat(best[node[split]], _span(self.kids[node[split]])))
            stay = waits & ~down
            node, other = (
                np.concatenate([node[stay], np.repeat(node[down], _span(tree.kids[other[down]])), below]),
                np.concatenate([other[stay], _ranges(tree.kids[other[down]]), np.repeat(other[split], _span(self.kids[node[split]]))]),
            )
        self._compare(np.concatenate([x for x, _ in ends]), np.concatenate([x for _, x in ends]), centroids, tree, out)
        return out

    def _compare(self, node: np.ndarray, other: np.ndarray, centroids: np.ndarray, tree: Tree, out: np.ndarray) -> None:
        """Vectors of leaves against the centroids of their pairs, in whole numbers."""
        spans = np.stack([tree.first[other], tree.last[other]], 1)
        node, number = np.repeat(node, _span(spans)), tree.order[_ranges(spans)]
        spans = np.stack([self.first[node], self.last[node]], 1)
        at, number = _ranges(spans), np.repeat(number, _span(spans))
        d = np.zeros(len(at), np.int64)
        for k in range(0, len(at), _PAIRS):
            d[k : k + _PAIRS] = ((self.points[at[k : k + _PAIRS]] - centroids[number[k : k + _PAIRS]]) ** 2).sum(1)
        order = np.lexsort((number, d, at))
        at, number = at[order], number[order]
        top = np.append(True, at[1:] != at[:-1])[: len(at)]
        out[at[top]] = number[top]


def _span(kids: np.ndarray) -> np.ndarray:
    return kids[:, 1] - kids[:, 0]


def _ranges(spans: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    size = spans[:, 1] - spans[:, 0]
    return np.repeat(spans[:, 0] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(spans) else np.zeros(0, np.int64)


def _vectors(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of ids and vectors."""
    ids: list = []
    held: list[np.ndarray] = []
    for batch in batches:
        v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
        ids += batch.column(0).to_pylist()
        held.append(v)
        if len(ids) >= BLOCK:
            points = np.concatenate(held)
            whole = len(ids) // BLOCK * BLOCK
            for k in range(0, whole, BLOCK):
                yield ids[k : k + BLOCK], points[k : k + BLOCK]
            ids, held = ids[whole:], [points[whole:]]
    if ids:
        yield ids, np.concatenate(held)


_PARTS = ("points", "center", "first", "last", "kids", "radius")


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of up to BLOCK rows of (id, v) with their cover trees, in a table that is dropped when the rounds are over."""
    schema = f"n int, {', '.join(f'{x} binary' for x in _PARTS)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points in _vectors(batches, dims):
            _, n, *parts = _packed(ids, points)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]], ["n", *_PARTS])

    return tables.cut(rows.mapInArrow(run, schema))


def _read(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Block]:
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            yield Block(row[0], dims, *row[1:])


def _sums(stored: DataFrame, centroids: np.ndarray) -> pd.DataFrame:
    """For each centroid with vectors: how many, the sums of their components, and of their distances (part dims)."""
    spark, (k, dims) = stored.sparkSession, centroids.shape
    sent = tables.sent(spark, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, tree = np.zeros((k, dims + 1), np.int64), np.zeros(k, np.int64), Tree(sent.value, 1)
        for block in _read(batches, dims):
            to = block.assigned(sent.value, tree)
            distance = ((block.points - sent.value[to]) ** 2).sum(1)
            for c in np.unique(to):
                mine = to == c
                count[c] += mine.sum()
                own[c, :dims] += block.points[mine].sum(0)
                own[c, dims] += distance[mine].sum()
        c = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, dims + 1)), pa.array(np.tile(np.arange(dims + 1), len(c))), pa.array(np.repeat(count[c], dims + 1)), pa.array(own[c].ravel())], ["cluster", "part", "n", "total"])

    out = stored.mapInArrow(run, "cluster long, part long, n long, total long").groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()  # at most k * (dims + 1) rows
    sent.destroy()
    return out.sort_values(["cluster", "part"])


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k rows with the smallest sha256 of `seed:id`; null ids come last, equal ids by their vectors."""
    digest: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in found], np.int64)


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are rows with dims components, none null or non-finite; x becomes floor(scale * x). Centroids start as the k rows of
    first_centroids() and are replaced `rounds` times by the floor of their vectors' means; empty ones stay. distance is the
    square. Cases: ties go to the smaller number; fewer than k rows give fewer centroids; repeated rows and ids count each;
    null ids are clustered, but start no centroid while others can; an empty table or one without a kept row gives no rows;
    other columns, whatever their names, are not read; a component of 2**27 / scale or more is an error, as its
    distances would not fit a long.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, dims, scale)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, cluster int, distance long"
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], f"{id_col} {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    stored = blocks(rows, dims)
    for _ in range(rounds):
        found = _sums(stored, centroids)
        new = centroids.copy()
        means = found[found["part"] < dims]
        new[means["cluster"].to_numpy(), means["part"].to_numpy()] = means["total"].to_numpy() // means["n"].to_numpy()
        if (new == centroids).all():  # all later rounds would give the same
            break
        centroids = new
    found = _sums(stored, centroids)
    tables.drop(stored)
    inertia = found[found["part"] == dims].set_index("cluster")["total"]
    sent = tables.sent(spark, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(sent.value, 1)
        for ids, points in _vectors(batches, dims):
            own, n, *parts = _packed(ids, points)
            block = Block(n, dims, *parts)
            to = block.assigned(sent.value, tree)
            distance = ((block.points - sent.value[to]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(own, batch_type), pa.array(to.astype(np.int32)), pa.array(distance)], ["id", "cluster", "distance"])

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(rows.schema["id"].dataType)
    out = rows.mapInArrow(run, schema)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # as many values as there are centroids: no join
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1)
    return out.select(
        F.col("id").alias(id_col), "cluster", "distance", of([int(inertia.get(c, 0)) for c in range(len(centroids))]).cast("long").alias("cluster_inertia"), F.lit(int(inertia.sum())).cast("long").alias("inertia"), of(digest).alias("centroid_sha256")
    )
