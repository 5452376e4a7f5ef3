"""Mixing sources to target weights: raked token weights and calibrated sampling.

Tokens are summed by cells of source, language and topic. Iterative proportional fitting scales the cells until
the shares of each dimension are its targets; documents are then drawn with probabilities in proportion to
their cell's weight. All in native DataFrame operations; cells stay in a table, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarray.llm.tables import cut

#: Cells up to which their table, of some hundred bytes each, is raked in one partition and broadcast; a larger one is
#: raked and joined by shuffles, with the same result.
SMALL_CELLS = 50_000
_GAP = r"[\x20\x09-\x0D]+"

#: Target shares: fixed ones by value, or a power of the share that is there (below 1 flattens it).
Targets = dict[str, dict[str, float] | float]
PRODUCTION: Targets = {"source": 0.7, "lang": {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}, "topic": 0.8}


def words(text: Column) -> Column:
    return F.when(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")) == "", 0).otherwise(F.size(F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), _GAP))).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic told by a text's form; null for null."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(t.rlike(r"(?i)\b(licen[sc]e|copyright|warranty)\b"), "legal")
        .when(t.rlike(r"[A-Za-z0-9._-]@[A-Za-z0-9-]+\.|\(\d{3}\) \d{3}-|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), "contact")
        .when(t.rlike(r" \| .* \| "), "table")
        .when(F.length(t) < 600, "short")
        .when(F.length(t) > 6000, "long")
        .otherwise("prose")
    )


def _key(c: Column) -> Column:
    """Null and empty are one category."""
    return F.coalesce(c.cast("string"), F.lit(""))


def _shares(cells: DataFrame, dim: str, target: dict[str, float] | float, total: float, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(dim, target share) of the values that have tokens. Values not named share what the named ones leave; if
    these fill it they keep their share of the tokens, and the named ones divide the rest. Shares are scaled to one."""
    margin = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("x"))
    if not isinstance(target, dict):
        wanted = F.pow(F.col("x") / total, F.lit(float(target)))
    else:
        named = reduce(lambda a, kv: a.when(F.col(dim) == kv[0], F.lit(float(kv[1]))), target.items(), F.when(F.lit(False), F.lit(0.0)))
        rest = max(0.0, 1.0 - sum(target.values()))
        other = margin.where(~F.col(dim).isin(list(target))).agg(F.sum("x")).first()[0] or 1.0
        if rest <= 1e-9:
            # as shares are scaled, this adds to the named ones what makes the others' part the one they have
            known = max(total - other, 0.0)
            rest = sum(target.values()) * other / known if known else 1.0
        wanted = named.otherwise(F.col("x") / other * rest)
    margin = kept(margin.select(dim, wanted.alias("w")))
    scale = margin.agg(F.sum("w")).first()[0] or 1.0
    return margin.select(dim, (F.col("w") / scale).alias("share"))


def raked(cells: DataFrame, targets: Targets, small: bool = False, rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """cells (one column for each dimension, tokens) with mass: the tokens scaled so that each dimension's shares
    are its targets, to within tolerance or after `rounds` rounds. Masses add up to all tokens. small: all in one partition."""
    kept = (lambda df: cut(df).coalesce(1)) if small else cut
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("mass", F.col("tokens").cast("double"))
    for d, t in targets.items():
        now = now.join(_shares(cells, d, t, total, kept).withColumnRenamed("share", f"{d}_share"), d)
    now = kept(now)

    def scaled(now: DataFrame, d: str) -> DataFrame:
        """Masses times what takes the dimension's shares to their targets; f: that factor."""
        if small:  # in one partition a window needs no shuffle, and the plan does not double with every step
            now = now.withColumn("m", F.sum("mass").over(Window.partitionBy(d)))
        else:
            now = now.join(now.groupBy(d).agg(F.sum("mass").alias("m")), d)
        f = F.when(F.col("m") > 0, F.col(f"{d}_share") * total / F.col("m")).otherwise(0.0)
        return now.withColumn("f", f).withColumn("mass", F.col("mass") * F.col("f")).withColumn("off", F.greatest("off", F.abs(F.col("f") - 1))).drop("m", "f")

    for _ in range(rounds):
        now = kept(reduce(scaled, targets, now.withColumn("off", F.lit(0.0))))
        if (now.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return now.drop("off", *[f"{d}_share" for d in targets])


def _rate(cells: DataFrame, budget: float) -> float:
    """The factor of weights for which the expected tokens, no probability over one, are the budget."""
    rate = budget / max(1e-9, float(cells.agg(F.sum("mass")).first()[0] or 0))
    for _ in range(60):
        full = F.col("mass") * rate >= F.col("tokens")
        r = cells.agg(F.sum(F.when(full, F.col("tokens"))).cast("double"), F.sum(F.when(~full, F.col("mass")))).first()
        capped, free = r[0] or 0.0, r[1] or 0.0
        if free <= 0:
            break
        new = max(rate, (budget - capped) / free)
        if new <= rate * (1 + 1e-12):
            break
        rate = new
    return rate


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dims: dict[str, Column] | None = None, targets: Targets | None = None, fraction: float = 0.5, seed: int = 42) -> DataFrame:
    """docs, as struct d, with the dimensions, tokens, weight, probability and sampled of every row.

    tokens: words between ASCII white space. weight: how much more of the cell's tokens the targets want than
    there are. probability: min(1, rate * weight), the rate such that a `fraction` of all tokens is expected;
    where it stays below one everywhere, the expected shares of the sample are the targets. sampled: a hash
    of id, text and seed, as a number in [0, 1), is below the probability, so that a rerun draws the same.

    Cases: null and empty sources or languages are one category, values without a target share what is left,
    or keep their share of the tokens where the targets add up to one;
    texts without words have no tokens but the probability of their cell; identical rows are drawn alike; rows
    without id are drawn by their text; an empty table gives no rows; columns of docs stay inside d.
    """
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col(text_col))}
    targets = targets or PRODUCTION
    rows = docs.select(F.struct(*docs.columns).alias("d"), *[_key(c).alias(n) for n, c in dims.items()], words(F.col(text_col)).alias("tokens"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    names = list(dims)
    every = cut(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")))
    small = every.count() <= SMALL_CELLS
    if small:
        every = every.coalesce(1)
    cells = raked(every.where("tokens > 0"), targets, small)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    rate = _rate(cells, fraction * total)
    weight = F.col("mass") / F.col("tokens")
    drawn = cells.select(*names, weight.alias("weight"), F.least(F.lit(1.0), rate * weight).alias("probability"))
    if small:
        drawn = F.broadcast(drawn)
    else:  # a hot cell's rows are split by adaptive execution: the join's sides are shuffled for it alone
        drawn = drawn.select(*names[:-1], F.concat(names[-1]).alias(names[-1]), "weight", "probability")
    out = rows.join(drawn, names, "left")
    u = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    # cells without any token have no weight of their own: their rows are drawn at the overall fraction
    p = F.coalesce("probability", F.lit(float(fraction)))
    return out.select("d", *names, "tokens", F.coalesce("weight", F.lit(1.0)).alias("weight"), p.alias("probability"), (u < p).alias("sampled"))


def mixture(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that are drawn, with their columns."""
    return mixed(docs, **options).where("sampled").select("d.*")
