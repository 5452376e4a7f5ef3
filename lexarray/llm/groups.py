"""Connected components of a similarity join without all pairs of a group.

Rows that share a token are candidates. In each round every token group that still spans several
components tests its members against one pivot; groups whose members are all connected drop out. What
remains is joined in full, between different components only, so that no link between two components is
lost, while a group of n similar rows costs about n tests instead of n * n / 2. Links inside one
component are not all listed: they cannot change a component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarray.llm import tables
from lexarray.llm.kernels import mix, signed
from lexarray.llm.tables import cut, drop

#: Links a partition holds.
ROWS = 200_000
#: Rounds with a pivot before what is left is joined in full, whatever the size.
TURNS = 4
#: So many of a key's first tokens tell there which of the tokens that two keys share is the first.
FIRST = 24


def turned(key: str) -> Column:
    """A key that no earlier shuffle is known to be dealt by: both sides of a join on it are then shuffled
    for that join, and adaptive execution can split a hot key's partition."""
    return F.col(key).bitwiseXOR(F.lit(1).cast("long"))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: each node with the smallest that it is connected to."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = [x for x in above if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """A table (k, c): each node of edges (a, b: long) with the smallest node of its connected component.

    The links of each partition, of about ROWS, become stars; then large-star and small-star steps in turn, each
    round cut in the shared folder, until nothing moves. Where one partition holds all, its stars are the components.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    state = None
    while True:
        parts = 1 + now.count() // ROWS
        stars = (now.coalesce(1) if parts == 1 else now.repartition(parts)).mapInArrow(_forest, "a long, b long")
        if parts > 1:
            both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).select(turned("a").alias("t"), "m")
            large = both.where("b > a").join(least, turned("a") == F.col("t")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            hung = large.join(least.select(turned("a").alias("t"), "m"), turned("a") == F.col("t"))
            small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
            stars = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        past, now = now, cut(stars)
        drop(past)
        if parts == 1:
            break
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    out = cut(now.select(F.col("a").alias("k"), F.col("b").alias("c")).unionByName(now.select(F.col("b").alias("k"), F.col("b").alias("c")).distinct()))
    drop(now)
    return out


#: What a token is counted by: so many high bits of it, its step and a count of one or more, in eight bytes.
_SHORT = 42


def _split(token: np.ndarray, step: np.ndarray) -> np.ndarray:
    return mix(token + step.astype(np.uint64) * np.full(1, 0x9E3779B97F4A7C15, np.uint64))


class _Seen:
    """Tokens with steps as packed numbers: 42 bits of a token, the step's low 6 and whether it came once or more."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0

    @staticmethod
    def packed(token: np.ndarray, step: np.ndarray) -> np.ndarray:
        return (token >> np.uint64(64 - _SHORT) << np.uint64(8)) | ((step & np.uint64(63)) << np.uint64(2)) | np.uint64(1)

    def add(self, packed: np.ndarray) -> None:
        self.held.append(packed)
        self.size += len(packed)

    def merged(self) -> np.ndarray:
        """Each token and step once, with 1 or 2 for a count of one or more."""
        every = np.concatenate([np.zeros(0, np.uint64), *self.held])
        every.sort()
        keys = every >> np.uint64(2)
        first = np.ones(len(every), bool)
        first[1:] = keys[1:] != keys[:-1]
        at = np.flatnonzero(first)
        times = np.diff(np.append(at, len(every)))
        return (keys[at] << np.uint64(2)) | np.where((times > 1) | (every[at] & np.uint64(3) > 1), 2, 1).astype(np.uint64)


def _shared_tokens(packed: DataFrame, parts: int) -> DataFrame:
    """token: the split tokens that two rows or more have, from packed numbers by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, _Seen] = {}
        for batch in batches:
            for part, numbers in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(part, _Seen()).add(np.frombuffer(numbers.as_py(), np.uint64))
        for part in list(seen):
            every = seen.pop(part).merged()
            token, step = every >> np.uint64(8), (every >> np.uint64(2)) & np.uint64(63)
            # a split token holds the rows of its step and of the one below
            below = np.zeros(len(every), bool)
            below[1:] = (token[1:] == token[:-1]) & (step[1:] == step[:-1] + np.uint64(1))
            found = (every & np.uint64(3) > 1) | below
            yield pa.RecordBatch.from_arrays([pa.array(signed(_split(token[found], step[found])))], ["token"])

    return packed.repartition(parts, "part").mapInArrow(run, "token long")


def candidates(base: DataFrame, size: str, columns: list[str], percent: int, mark: Column, placed: bool = False) -> DataFrame:
    """A table (token, k, size, columns; pos too if placed) of the rows of base whose tokens others of a similar size share.

    base: k, size, columns (all long) and tokens (array of long; pos is a token's place in it, null arrays have none);
    several rows may have one k, and that with the least mark (long) stands for all, but for false hits of a filter: copies in
    many tasks neither share their tokens with each other nor multiply what is compared. Sizes are alike if the smaller is at least percent % of the larger: tokens are split
    by steps of sizes, each row being in two, so that rows alike in size share one, and a frequent token's group
    falls into many. Tokens without a second row go, but for false hits of a filter; tokens are counted by their
    first 42 bits, which adds such hits but loses none.
    """
    spark = base.sparkSession
    columns = [size, *columns]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def listed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of a batch (tokens, k, size, ...), their rows and places, and steps."""
        lists = batch.column(0)
        lengths = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        step = np.floor(np.log(np.maximum(batch.column(2).to_numpy(), 1)) / -np.log(percent / 100) + 1e-9).astype(np.uint64)
        return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), row, place.astype(np.int64), step[row]

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that stand for their keys, without the mark."""
        bloom = tables.Bloom(chosen.value)
        for batch in batches:
            last = batch.num_columns - 1
            yield batch.filter(pa.array(bloom.has(batch.column(last).to_numpy().view(np.uint64)))).select(range(last))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()

        def emitted() -> Iterator[pa.RecordBatch]:
            every = seen.merged()
            part = (every >> np.uint64(_SHORT + 8 - 16)).astype(np.int64) * parts >> 16  # ranges of tokens: every is sorted
            at = np.flatnonzero(np.diff(part, prepend=-1))
            ends = np.append(at[1:], len(every))
            yield pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array([every[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], ["part", "packed"])

        for batch in standing(batches):
            token, _, _, step = listed(batch)
            seen.add(_Seen.packed(token, step))
            if seen.size > 1 << 22:
                yield from emitted()
                seen = _Seen()
        if seen.size:
            yield from emitted()

    rows = base.where("tokens is not null").select("tokens", "k", *columns, mark.bitwiseXOR(F.col("k")).alias("mark"))
    one = rows.groupBy("k").agg(F.min(F.col("mark").bitwiseXOR(F.col("k"))).alias("mark"))
    chosen = tables.sent(spark, tables.bloom_of(one.select(F.col("mark").bitwiseXOR(F.col("k")))).words)
    shared = cut(_shared_tokens(rows.mapInArrow(counted, "part int, packed binary"), parts))
    filtered = tables.sent(spark, tables.bloom_of(shared).words)
    drop(shared)

    def sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = tables.Bloom(filtered.value)
        for batch in standing(batches):
            token, row, pos, step = listed(batch)
            short = token >> np.uint64(64 - _SHORT)
            for up in range(2):
                keep = np.flatnonzero(bloom.has(_split(short, (step + np.uint64(up)) & np.uint64(63)))) if len(token) else np.zeros(0, np.int64)
                of = pa.array(row[keep])
                own = [pa.array(signed(_split(token[keep], step[keep] + np.uint64(up)))), *(c.take(of) for c in batch.columns[1:])]
                yield pa.RecordBatch.from_arrays([*own, pa.array(pos[keep])] if placed else own, ["token", *batch.schema.names[1:]] + ["pos"] * placed)

    out = cut(rows.mapInArrow(sharing, "token long, k long" + "".join(f", {c} long" for c in columns) + ", pos long" * placed))
    filtered.destroy()
    chosen.destroy()
    return out


def linked(members: DataFrame, near: Callable[[str, str], Column], prepare: Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], DataFrame | None]], closer: Callable[[str, str], Column] | None = None, small: int = 2) -> DataFrame | None:
    """Components (k, c) of the keys that have links, or None where there is none.

    members: a table (token, k and what near compares), which is deleted; near(x, y): the test that needs only
    members' columns, by the names of two structs; prepare: given a table of the keys (k) that may be asked for, the
    function that keeps the pairs (a, b) that are links, and a table of k and columns that closer(x, y) tests besides
    near where all pairs of what is left are compared; small: groups of up to so many keys are compared in full, by near alone, in
    the second round, so that later rounds have the larger ones only. A pivot is the same for all tokens that the same keys share,
    so that a group of copies is tested against few.
    """
    columns = [c for c in members.columns if c not in ("token", "k")]
    rows, held, labels, verify, detail, turn = members, members, None, None, None, 0
    tested: list[DataFrame] = []
    links: list[DataFrame] = []
    every = lambda parts: reduce(DataFrame.unionByName, parts)
    last = False
    while not last:
        now = rows.withColumn("c", F.col("k"))
        if labels is not None:
            now = rows.join(labels.select(turned("k").alias("t"), "c"), turned("k") == F.col("t"), "left").select("token", "k", F.coalesce("c", "k").alias("c"), *columns)
            now = cut(now)
            drop(held)
            held = now
        # groups that still span several components, each with its pivot: keys are hashes, so one of them is as good as drawn
        key = F.col("k").bitwiseXOR(F.xxhash64(F.lit(turn)))
        pivot = F.min(F.struct(key.alias("o"), *["c"] * (labels is not None), *columns)).alias("y")
        bounds = [F.min("c").alias("c0"), F.max("c").alias("c1")] if labels is not None else [F.min("k").alias("c0"), F.max("k").alias("c1")]
        spread = now.groupBy("token").agg(*bounds, F.count("*").alias("of"), pivot).where("c0 <> c1")
        own = F.col("y.o").bitwiseXOR(F.xxhash64(F.lit(turn)))
        spread = cut(spread.select("token", "of", F.struct(own.alias("k"), (F.col("y.c") if labels is not None else own).alias("c"), *[f"y.{c}" for c in columns]).alias("y")))
        state = now.select("token", turned("token").alias("t"), F.struct("k", "c", *columns).alias("x")).join(spread.select(turned("token").alias("t"), "of", "y"), "t")
        with_pivot = F.when((F.col("x.c") != F.col("y.c")) & near("x", "y"), F.col("y.k"))
        state = cut(state.select("token", "x", with_pivot.alias("b"), "of"))
        drop(held, spread)
        held = state
        if state.isEmpty():
            break
        last = turn == TURNS
        if last:
            # a pair is made by the first token that both have, as far as the first tokens of each tell, not by every one
            test = near("x", "y") & (closer("x", "y") if detail is not None else F.lit(True)) & ~F.arrays_overlap("x.below", "y.below")
            # (where tokens have places, what near tests holds for the one that comes first by these)
            place = lambda x, t: F.struct(*[F.col(f"{x}pos")] * ("pos" in columns), t.alias("t"))
            least = state.groupBy(F.col("x.k").alias("k")).agg(F.slice(F.sort_array(F.collect_set(place("x.", turned("token")))), 1, FIRST).alias("below"))
            fine = least if detail is None else least.join(detail.select(turned("k").alias("u"), *[c for c in detail.columns if c != "k"]), turned("k") == F.col("u")).drop("u")
            mine = state.select(turned("token").alias("t"), "x.*").join(fine.withColumnRenamed("k", "u"), turned("k") == turned("u")).drop("u")
            mine = mine.withColumn("own", place("", F.col("t"))).withColumn("below", F.transform(F.filter("below", lambda x: x < F.col("own")), lambda x: x["t"])).drop("own")
            mine = cut(mine.select("t", F.struct([c for c in mine.columns if c != "t"]).alias("x")))
            pairs = mine.join(mine.withColumnRenamed("x", "y"), "t").where((F.col("x.c") < F.col("y.c")) & test).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"))
        else:
            pairs = state.where(F.col("b").isNotNull() & (F.col("of") > (small if turn else 0))).select(F.col("x.k").alias("a"), "b")
            if turn and small > 2:
                few = state.where(F.col("of") <= small).select(turned("token").alias("t"), "x")
                both = few.join(few.withColumnRenamed("x", "y"), "t").where((F.col("x.c") < F.col("y.c")) & near("x", "y"))
                pairs = pairs.unionByName(both.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")))
        # a group of two is done with
        rows = state.where(F.col("of") > (small if turn else 2)).select("token", "x.k", *[f"x.{c}" for c in columns])
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        tested.append(cut(pairs.join(every(tested), ["a", "b"], "left_anti") if tested else pairs))
        if verify is None:
            keys = tested[0].select(F.explode(F.array("a", "b")).alias("k")).unionByName(rows.select("k"))
            keys = cut(keys.distinct())
            verify, detail = prepare(keys)
            drop(keys)
        if last:
            drop(mine)
        found = verify(tested[-1])
        if not found.isEmpty():
            links.append(found)
            drop(labels)
            labels = components(every(links))
        else:
            drop(found)
        turn += 1
    drop(held, *tested, *links)
    return labels
