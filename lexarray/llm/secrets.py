"""Secret scanning: fixed patterns, and strings that pass a battery of randomness tests.

Everything is one chain of native projections. Where a pattern matches is worked out from the lengths of
the matches and of the pieces between them, as no built-in function returns positions of all matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns. Of assign, a match counts if group 2 has 8 characters or more; the others say so themselves
#: (a maximal run of the class is a match, whatever its parts).
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: What the battery looks at.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"

#: Encodings by their alphabets, the first that fits is inferred: name, pattern, symbols in order.
ENCODINGS = (
    ("decimal", r"^[0-9]+$", "0123456789"),
    ("hex", r"^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", r"^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)

KINDS = ("assign", "access", "hex", "random")


def _found(text: Column, pattern: str, sized_by: int = 0) -> Column:
    """All non-overlapping matches, leftmost first: length of the gap before, the match and the size of a group."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.zip_with(F.split(text, pattern), matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("s")))
    found = F.filter(found, lambda x: x["s"].isNotNull())  # pieces are one more than matches
    if sized_by:
        found = F.zip_with(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(sized_by)), lambda x, g: F.struct(x["gap"].alias("gap"), x["s"].alias("s"), F.length(g).alias("size")))
    else:
        found = F.transform(found, lambda x: F.struct(x["gap"].alias("gap"), x["s"].alias("s"), F.length(x["s"]).alias("size")))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<gap:int,s:string,size:int>>"))


#: A text of 2**31 characters has fewer matches than 2 to this.
_DOUBLINGS = 28


def _ends(df: DataFrame, names: list[str]) -> DataFrame:
    """df with n_ends for each array n of matches: where they end. Running sums by doubling, in steps that cost nothing
    for arrays that are shorter: a text with m matches takes time m * log(m)."""
    df = df.select("*", *[F.transform(n, lambda x: x["gap"] + F.length(x["s"])).alias(f"{n}_ends") for n in names])
    for k in range(_DOUBLINGS):
        further = lambda c: F.transform(c, lambda x, i: x + F.coalesce(F.get(c, i - (1 << k)), F.lit(0)))  # noqa: B023, E731
        df = df.withColumns({f"{n}_ends": F.when(F.size(f"{n}_ends") > 1 << k, further(F.col(f"{n}_ends"))).otherwise(F.col(f"{n}_ends")) for n in names})
    return df


def _placed(name: str) -> Column:
    return F.zip_with(name, f"{name}_ends", lambda x, e: F.struct((e - F.length(x["s"])).alias("start"), e.alias("end"), x["size"].alias("size"), x["s"].alias("s")))


def _square(x: Column) -> Column:
    return x * x


def _tested(c: Column) -> Column:
    """A candidate with its encoding and its symbols' places in the alphabet. Names of joined words, in which each capital
    is followed by a small letter, count in lower case."""
    s = F.when(c["s"].rlike("[A-Z](?![a-z])"), c["s"]).otherwise(F.lower(c["s"]))
    body = F.regexp_replace(s, "=+$", "")
    name, alphabet, known = F.lit(None).cast("string"), F.lit(""), F.lit(0)
    for label, pattern, symbols in reversed(ENCODINGS):
        fits = s.rlike(pattern)
        name, alphabet, known = F.when(fits, label).otherwise(name), F.when(fits, F.lit(symbols)).otherwise(alphabet), F.when(fits, len(symbols)).otherwise(known)
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), name.alias("encoding"), F.transform(F.filter(F.split(body, ""), lambda x: x != ""), lambda x: F.instr(alphabet, x)).alias("v"), known.cast("double").alias("k"))


def _changes(values: Column) -> Column:
    """How often neighbours differ."""
    return F.aggregate(values, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("last")), lambda a, x: F.struct((a["n"] + F.when((a["last"] >= 0) & (a["last"] != x), 1).otherwise(0)).alias("n"), x.alias("last")), lambda a: a["n"].cast("double"))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _measured(c: Column) -> Column:
    """The sums that the tests need; all of a candidate's characters are read."""
    v, n = c["v"], F.size(c["v"]).cast("double")
    squares = _total(F.transform(F.array_distinct(v), lambda x: _square(F.size(F.filter(v, lambda y: y == x)).cast("double"))))
    mean = _total(v) / n
    products = F.aggregate(v, F.struct(F.lit(0.0).alias("p"), F.lit(None).cast("double").alias("last")), lambda a, x: F.struct((a["p"] + F.coalesce((a["last"] - mean) * (x - mean), F.lit(0.0))).alias("p"), x.cast("double").alias("last")), lambda a: a["p"])
    variance = _total(F.transform(v, lambda x: _square(x - mean)))
    upper = F.transform(v, lambda x: (x > c["k"] / 2).cast("int"))
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), n.alias("n"), c["k"].alias("k"), squares.alias("squares"), products.alias("products"), variance.alias("variance"), _total(upper).alias("n1"), _changes(upper).alias("runs"))


#: How structured a string has to be not to be random: the correlation of neighbours, and the share of changes about the
#: middle by which it is off the expected one. Runs, sequences and sorted strings have more of both.
CORRELATED, UNEVEN = 0.8, 0.4

#: Per mille of the letters a to z in English text, and as how many letters they count beside the corpus's own.
ENGLISH = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
PRIOR = 10_000


def letter_odds(docs: DataFrame, text_col: str = "text") -> tuple[float, float]:
    """How likely two letters, and three, of a word are the same one: by the counts of A-Z in all whole texts in either case,
    with ENGLISH as PRIOR letters more, so that a small or empty corpus has odds too, or by ENGLISH alone where its pairs are
    rarer, as names in code are English in any corpus. Collects 26 numbers."""
    low = docs.select(F.lower(F.col(text_col)).alias("t"))
    count = lambda c: F.coalesce(F.sum(F.octet_length("t") - F.octet_length(F.replace("t", F.lit(c)))), F.lit(0))
    found = low.agg(*[count(chr(97 + i)).alias(f"n{i}") for i in range(26)]).first()
    counts = [n + PRIOR * e / sum(ENGLISH) for n, e in zip(found, ENGLISH, strict=True)]
    odds = lambda x: tuple(sum((n / sum(x)) ** power for n in x) for power in (2, 3))
    return min(odds(counts), odds(ENGLISH))


def _below(z: Column) -> Column:
    """The normal distribution's share below z, by Page's approximation."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _judged(c: Column, odds: tuple[float, float]) -> Column:
    """p: of three tests the largest p-value, each of the hypothesis that the string is made as words or sequences are.

    Chi-squared: over k symbols it is k (n - 1) U + k - n, where U is the share of pairs of the string's characters that are
    equal. Under the hypothesis a pair is equal with the corpus's odds for letters (at least twice those of random symbols),
    which gives the exact mean and variance; the p-value is that of a gamma variable with these, by Wilson and Hilferty.
    Runs: the share of changes about the middle is off by UNEVEN; serial: the correlation is CORRELATED. A string counts as
    random only if all three reject, so the largest p-value holds for their combination.
    """
    n, k, (two, three) = c["n"], c["k"], odds
    share = F.greatest(F.lit(two), 2 / k)
    pairs = n * (n - 1) / 2
    variance = n * (n - 1) / 4 * (4 * (n - 2) * share * share * (three / two**2 - 1) + 2 * share * (1 - share))
    spread = variance / (9 * _square(pairs * share))
    uniform = _below((F.cbrt((c["squares"] - n) / 2 / (pairs * share)) - (1 - spread)) / F.sqrt(spread))
    n1, n0 = c["n1"], n - c["n1"]
    expected = 2 * n1 * n0 / (n * (n - 1))
    runs = F.when((n1 > 0) & (n0 > 0), _below((F.abs(c["runs"] / (n - 1) - expected) - UNEVEN) * F.sqrt(n - 1) / 0.4)).otherwise(1.0)
    serial = F.when(c["variance"] > 0, _below((F.abs(c["products"] / c["variance"] + 1 / n) - CORRELATED) * F.sqrt(n) / float((1 - CORRELATED**2) ** 0.5))).otherwise(1.0)
    fits = c["encoding"].isNotNull() & (c["encoding"] != "decimal")
    return F.struct(F.when(fits, F.greatest(uniform, runs, serial)).otherwise(1.0).alias("p"), n.alias("n"), c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"))


def scanned(docs: DataFrame, text_col: str = "text", rate: float = 0.02, odds: tuple[float, float] | None = None) -> DataFrame:
    """docs, as struct d, with base and random: arrays of spans of every whole text.

    base spans (start, end, kind 0 to 2) come from the fixed patterns. random spans are strings of 20 or more
    characters of an encoding's alphabet (decimals aside) that do not overlap base spans and that the battery tells from
    words: chi-squared uniformity over the inferred alphabet, runs about its middle and serial correlation give one
    p-value (see _judged), and Benjamini and Hochberg's procedure at `rate` over the text's candidates, each weighted by
    its share of their length, picks those that are random; of equal p-values the longer one comes first, then the earlier
    one. odds: letter_odds() of the texts to compare with, by default of docs.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    odds = odds or letter_odds(docs, text_col)
    kinds = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "cand": (CANDIDATE, 0)}
    out = docs.select(F.struct(*docs.columns).alias("d"), text.alias("t"))
    out = _ends(out.select("d", *[_found(F.col("t"), p, g).alias(n) for n, (p, g) in kinds.items()]), list(kinds))
    out = out.select("d", *[_placed(n).alias(n) for n in kinds])
    span = lambda kind: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    base = F.concat(F.transform(F.filter("assign", lambda x: x["size"] >= 8), span(0)), F.transform("access", span(1)), F.transform("hex", span(2)))
    out = out.select("d", F.sort_array(F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))).alias("base"), F.col("cand"))
    clear = F.filter("cand", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    out = out.withColumn("cand", clear)
    out = out.withColumn("cand", F.transform("cand", _tested))
    out = out.withColumn("cand", F.transform(F.filter("cand", lambda c: F.size(c["v"]) > 3), _measured))
    out = out.withColumn("cand", F.transform("cand", lambda c: _judged(c, odds)))
    out = out.withColumn("m", F.size("cand")).withColumn("length", _total(F.transform("cand", lambda c: c["n"])))
    ranked = F.sort_array(F.transform("cand", lambda c: F.struct((c["p"] * F.col("length") / (c["n"] * F.col("m"))).alias("q"), c["start"].alias("start"), c["end"].alias("end"))))
    out = out.withColumn("cand", ranked)
    last = F.aggregate(F.transform("cand", lambda c, i: F.when(c["q"] <= rate * (i + 1) / F.col("m"), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    out = out.withColumn("last", last)
    random = F.transform(F.slice("cand", F.lit(1), F.col("last")), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return out.select("d", "base", random.alias("random"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float | tuple[float, float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs.

    spans lists kind:start:end by start, then kind, in code points with the end excluded; base_sha256 is the
    digest of the base spans listed so. Cases: null and empty texts have none; repeated rows get equal results;
    very long texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    out = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **options)
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return out.select("d.doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.sort_array(F.concat("base", "random"))).alias("spans"))
