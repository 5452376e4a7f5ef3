"""A Merkle manifest of a table: a digest for every row, a tree for every group, one root, and a proof for every row.

Rows are sorted by ranges of group and id. A row's place in its group is its place in its range's run of that group plus the
rows that earlier ranges hold of it. Each task builds the subtrees that lie whole in its run; the nodes at the ragged ends of
runs are shuffled by their place, and upper levels are finished from them, level by level. Each run then gets the few nodes
beside it, from which, and its own, its tasks give every row the siblings of its path. The trees' tops are the leaves of one
more tree, built in the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexarray.llm import tables

#: Nodes that one node joins, as a power of two.
_BITS = 3
_WIDE = 1 << _BITS
#: Rows whose proofs are given out at a time.
_SLICE = 4096
_HEAD, _BESIDE, _LEAF = range(3)
_PROOF = "array<struct<left:string,right:string>>"


def _digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf_of(columns: list[Column]) -> Column:
    """The digest of values, each as its UTF-8 byte count, a colon and itself, or as `-` where it is null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and a proof lead to."""
    return F.aggregate(proof, leaf, lambda x, p: F.sha2(F.concat(p["left"], x, p["right"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf up and from left to right, as one text."""
    return F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), "")


class Levels:
    """The nodes of one group that follow from a run of its leaves, base the first one's place, of total leaves in the group."""

    def __init__(self, leaves: list[str], base: int, total: int) -> None:
        self.start, self.nodes, self.sizes = [base], [leaves], [total]
        while self.sizes[-1] > 1:
            start, own, size = self.start[-1], self.nodes[-1], self.sizes[-1]
            end = start + len(own)
            a, b = -(-start // _WIDE), -(-size // _WIDE) if end == size else end // _WIDE
            self.start.append(a)
            self.nodes.append([_digest(own[k * _WIDE - start : (k + 1) * _WIDE - start]) for k in range(a, b)])
            self.sizes.append(-(-size // _WIDE))

    def ragged(self) -> Iterator[tuple[int, int, str, bool]]:
        """(level, place, digest, last) of the nodes whose parent does not follow from this run, the group's top included."""
        for level, (start, own, size) in enumerate(zip(self.start, self.nodes, self.sizes, strict=True)):
            above = range(self.start[level + 1], self.start[level + 1] + len(self.nodes[level + 1])) if size > 1 else ()
            inside = range(above[0] * _WIDE - start, above[-1] * _WIDE + _WIDE - start) if len(above) else range(0)
            for k in [*range(min(len(own), inside.start)), *range(inside.stop, len(own))] if len(above) else range(len(own)):
                yield level, start + k, own[k], start + k == size - 1

    def paths(self, beside: dict[tuple[int, int], str]) -> Iterator[list[tuple[str, str]]]:
        """For each leaf the digests left and right of its path's node at every level; beside: nodes that others built."""
        held: list[tuple[int, str]] = [(-1, "")] * len(self.sizes)  # of the last parent: its place and its nodes
        above: tuple[int, list[tuple[str, str]]] = (-1, [])

        def family(level: int, parent: int) -> str:
            if held[level][0] != parent:
                start, own = self.start[level], self.nodes[level]
                places = range(parent * _WIDE, min((parent + 1) * _WIDE, self.sizes[level]))
                held[level] = parent, "".join(own[j - start] if 0 <= j - start < len(own) else beside[level, j] for j in places)
            return held[level][1]

        def sides(level: int, place: int) -> tuple[str, str]:
            nodes, k = family(level, place >> _BITS), 64 * (place % _WIDE)
            return nodes[:k], nodes[k + 64 :]

        top = len(self.sizes) - 1
        for i in range(self.start[0], self.start[0] + len(self.nodes[0])):
            if above[0] != i >> _BITS:
                above = i >> _BITS, [sides(level, i >> _BITS * level) for level in range(1, top)]
            yield [sides(0, i), *above[1]] if top else []


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict], dict[str, list]]]:
    """The head, the nodes beside and the leaves' columns of each run of rows that are sorted by run and kind."""
    head, beside, leaves = None, [], {}
    for batch in batches:
        names = batch.schema.names
        kinds = batch.column("kind").to_pylist()
        a = 0
        while a < len(kinds):
            b = a
            while b < len(kinds) and kinds[b] == kinds[a]:
                b += 1
            part = batch.slice(a, b - a)
            if kinds[a] == _HEAD:
                for row in part.to_pylist():
                    if head is not None:
                        yield head, beside, leaves
                    head, beside, leaves = row, [], {}
            elif kinds[a] == _BESIDE:
                beside += part.select(["level", "place", "digest"]).to_pylist()
            else:
                for name in names:
                    if name in _OF_LEAVES:
                        leaves.setdefault(name, []).extend(part.column(name).to_pylist())
            a = b
    if head is not None:
        yield head, beside, leaves


_OF_LEAVES = ("id", "digest", "shown")


class Forest:
    """Trees over rows (id, g, digest, shown), one for each g, its leaves in the order of columns `order`."""

    def __init__(self, rows: DataFrame, order: list[str]) -> None:
        number = F.monotonically_increasing_id() % (1 << 33)
        placed = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
        self.rows = tables.cut(placed.select("id", "g", "digest", "shown", F.spark_partition_id().alias("part"), number.alias("pos"), F.lit(_LEAF).alias("kind")))
        found = self.rows.groupBy("part", "g").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
        before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        #: a row for each range and group that meet
        self.runs = tables.cut(found.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)), "total": F.sum("n").over(Window.partitionBy("g")), "kind": F.lit(_HEAD)}))
        last, most = self.runs.agg(F.max("part"), F.max("total")).first()
        self.parts, self.height = (last or 0) + 1, 0
        while _WIDE**self.height < (most or 0):
            self.height += 1
        self.nodes = self._built()

    def _by_run(self, *frames: DataFrame) -> DataFrame:
        out = self.rows
        for x in frames:
            out = out.unionByName(x, allowMissingColumns=True)
        return out.repartitionById(self.parts, "part").sortWithinPartitions("part", "pos", "kind")

    def _built(self) -> list[DataFrame]:
        """Tables (g, level, place, digest, last) of the nodes at ragged ends and above them; last: the last of its level."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for head, _, leaves in _runs(batches):
                found = list(Levels(leaves["digest"], head["base"], head["total"]).ragged())
                columns = [pa.array(x) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([head["g"]] * len(found)), columns[0].cast(pa.int32()), *columns[1:]], ["g", "level", "place", "digest", "last"])

        ragged = tables.cut(self._by_run(self.runs).mapInArrow(run, "g string, level int, place long, digest string, last boolean"))
        out, below = [ragged], ragged.where("level = 0")
        for level in range(1, self.height + 1):
            each = F.sort_array(F.collect_list(F.struct("place", "digest")))  # eight at most
            joined = F.sha2(F.array_join(F.transform(each, lambda x: x["digest"]), ""), 256)
            above = below.where("not (last and place = 0)").groupBy("g", F.shiftright("place", _BITS).alias("place")).agg(joined.alias("digest"), F.max("last").alias("last"))
            built = tables.cut(above.select("g", F.lit(level).alias("level"), "place", "digest", "last"))
            out.append(built)
            below = ragged.where(F.col("level") == level).unionByName(built)
        return out

    def known(self) -> DataFrame:
        out = self.nodes[0]
        for x in self.nodes[1:]:
            out = out.unionByName(x)
        return out

    def tops(self) -> DataFrame:
        """(g, digest) of the tree of each group."""
        return self.known().where("last and place = 0").select("g", "digest")

    def beside(self) -> DataFrame:
        """The nodes that each run needs from others: children of the parents that its ends share with them."""
        levels = self.runs.select("part", "pos", "g", "base", "total", (F.col("base") + F.col("n")).alias("end"), F.explode(F.sequence(F.lit(0), F.lit(self.height))).alias("level"))
        span = F.expr(f"shiftleft(1L, {_BITS} * (level + 1))")
        asked = levels.where(f"shiftleft(1L, {_BITS} * level) < total").withColumn("span", span)
        asked = asked.withColumn("up", F.explode(F.array_distinct(F.array(F.floor(F.expr("base div span")), F.floor(F.expr("(end - 1) div span"))))))
        asked = asked.where("not (up * span >= base and least((up + 1) * span, total) <= end)")
        nodes = self.known().withColumn("up", F.shiftright("place", _BITS))
        return asked.join(nodes, ["g", "level", "up"]).select("part", "pos", F.lit(_BESIDE).alias("kind"), "level", "place", "digest")

    def proved(self, heads: DataFrame | None = None) -> DataFrame:
        """(id, g, digest, shown, place, top, root, proof) of every row. heads: (g, top, root, rest): what each group's proofs
        end with and lead to. The tables of nodes are dropped, those of rows stay for this result."""
        runs = self.runs
        if heads is None:
            heads = self.tops().select("g", F.col("digest").alias("top"), F.col("digest").alias("root"), F.array().cast(_PROOF).alias("rest"))
        #: what the runs get besides their leaves
        extra = self.extra = tables.cut(runs.join(heads, "g").unionByName(self.beside(), allowMissingColumns=True))
        tables.drop(self.runs, *self.nodes)
        kind = self.rows.schema["id"].dataType
        known = to_arrow_type(kind)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for head, beside, leaves in _runs(batches):
                paths = Levels(leaves["digest"], head["base"], head["total"]).paths({(x["level"], x["place"]): x["digest"] for x in beside})
                rest = [(x["left"], x["right"]) for x in head["rest"]]
                for a in range(0, len(leaves["digest"]), _SLICE):
                    n = min(_SLICE, len(leaves["digest"]) - a)
                    steps, ends = [], [0]
                    for _ in range(n):
                        steps += next(paths)
                        steps += rest
                        ends.append(len(steps))
                    sides = pa.StructArray.from_arrays([pa.array([x for x, _ in steps], pa.string()), pa.array([x for _, x in steps], pa.string())], ["left", "right"])
                    same = [pa.array([head[x]] * n, pa.string()) for x in ("g", "top", "root")]
                    own = [pa.array(leaves[x][a : a + n], t) for x, t in (("id", known), ("digest", pa.string()), ("shown", pa.string()))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(range(head["base"] + a, head["base"] + a + n), pa.int64()), *same, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), sides)], ["id", "digest", "shown", "place", "g", "top", "root", "proof"])

        schema = f"id {kind.simpleString()}, digest string, shown string, place long, g string, top string, root string, proof {_PROOF}"
        return self._by_run(extra).mapInArrow(run, schema)


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang", presented: dict[str, Column] | None = None) -> DataFrame:
    """(id, group, place, leaf, shown, subroot, root, proof) of every row of docs.

    leaf: leaf_of() the columns. In a group leaves ascend by id; every eight nodes (the last ones: fewer, even one) become one
    until one is left, subroot. Subroots ascend by group and become root likewise. proof: for each level from the leaf
    through subroot to root the digests left and right of the path, each side's as one text. shown: the leaf of the row as
    presented, whose columns are given by `presented` (by default the row itself); folded(shown, proof) = root verifies it.

    Cases: null ids and the null group come first; equal ids go by leaf, and equal leaves are interchangeable; values are
    hashed as text whatever their length; a group of one row is its own subroot, and one group's subroot the root; an
    empty table gives no rows; columns of docs that are not named, and clashing names, are not read.
    """
    presented = presented or {}
    shown = leaf_of([presented.get(c, F.col(c)) for c in columns]) if presented else F.lit(None).cast("string")
    leaves = docs.select(F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("g"), leaf_of([F.col(c) for c in columns]).alias("digest"), shown.alias("shown"))
    leaves = tables.cut(leaves.withColumn("shown", F.when(F.col("shown") != F.col("digest"), F.col("shown"))).withColumn("uid", F.monotonically_increasing_id()))
    forest = Forest(leaves, ["id", "digest", "uid"])  # uid: equal rows, however many, are spread over ranges
    tables.drop(leaves)
    tops = Forest(forest.tops().select(F.col("g").alias("id"), F.lit("").alias("g"), "digest", F.lit(None).cast("string").alias("shown")), ["id"])
    heads = tops.proved().select(F.col("id").alias("g"), F.col("digest").alias("top"), "root", F.col("proof").alias("rest"))
    out = forest.proved(heads)
    tables.drop(tops.rows, tops.extra)
    group = F.when(F.col("g") != "", F.expr("substring(g, 2)")).cast(docs.schema[group_col].dataType)
    return out.select(F.col("id").alias(id_col), group.alias(group_col), "place", F.col("digest").alias("leaf"), F.coalesce("shown", "digest").alias("shown"), F.col("top").alias("subroot"), "root", "proof")
