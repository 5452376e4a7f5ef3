"""Quality rules: a threshold table compiled into one projection of native expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common function words of the languages covered, lower-case.
STOP_WORDS = {
    "en": "the of and to in is that for it as with was on be by are this an at from or a not have has",
    "fr": "le la les de des du et en un une que qui dans pour par sur est pas au avec ce",
    "de": "der die das und den von zu mit ist im ein eine nicht auf für sich dem in als",
    "es": "el los las y que del se por con no una un su al es lo como de la en",
}


class Rule(NamedTuple):
    """A ratio of a document and the range that passes; None: no bound."""

    name: str
    metric: str
    low: float | None
    high: float | None


#: The threshold table. A rule says nothing of a text for which its ratio is not defined, which is null.
RULES = (
    Rule("words_too_short", "mean_word_chars", 2.5, None),
    Rule("words_too_long", "mean_word_chars", None, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.06, None),
    Rule("letters", "letter_ratio", 0.75, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.3),
)

_SPACE = " \t\n\x0b\f\r"
_GAP = r"[\x20\x09-\x0D]+"
_WINDOW = 8
#: Scripts that are written without spaces between words.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that fail, as one expression over the metric columns."""
    failed = []
    for r in rules:
        x = F.col(r.metric)
        bad = [x < r.low] * (r.low is not None) + [x > r.high] * (r.high is not None)
        failed.append(F.when(bad[0] if len(bad) == 1 else bad[0] | bad[1], F.lit(r.name)))
    return F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def with_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", stop_words: dict[str, str] = STOP_WORDS) -> DataFrame:
    """docs, as struct d, with the counts and ratios of every whole text.

    stop_ratio is counted with the words of all languages listed, as labels may be wrong, and null for texts of
    other languages and of none; mean_word_chars is null where most characters are of scripts without spaces. Words are maximal runs without ASCII white space. Null texts have none. n_repeat_words counts the words
    inside 8-word windows that occur at least twice in the text, the first occurrence included.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = F.btrim(text, F.lit(_SPACE))
    lang = F.lower(F.substring_index(F.col(lang_col).cast("string"), "-", 1)) if lang_col in docs.columns else F.lit(None).cast("string")
    out = docs.select(F.struct(*docs.columns).alias("d"), lang.isin(list(stop_words)).alias("listed"), text.alias("t"), F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, _GAP)).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    stop = sorted({w for words in stop_words.values() for w in words.split()})
    joined = F.array_join("w", "")
    unspaced = F.length(F.regexp_replace(joined, "[^" + "".join(rf"\p{{Is{x}}}" for x in UNSPACED) + "]+", ""))
    out = out.select(
        "d",
        "listed",
        # a text with most characters of three bytes has over two bytes a character; others need no second look
        F.when(F.octet_length(joined) > 2 * F.length(joined), 2 * unspaced > F.length(joined)).otherwise(False).alias("unspaced"),
        F.size("w").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        lines.alias("l"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(stop))).alias("n_stop"),
        F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))).alias("n_letter"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    last = F.size("h") - _WINDOW
    windows = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(_WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("g", windows).drop("h")
    # only texts with a repeated window pay for the sort that finds where it stands
    paired = F.when(F.size("g") > F.size(F.array_distinct("g")), F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    out = out.withColumn("g", paired)
    same = lambda i, x: F.get("g", i)["h"] == x["h"]
    places = F.sort_array(F.transform(F.filter("g", lambda x, i: F.coalesce(same(i - 1, x), F.lit(False)) | F.coalesce(same(i + 1, x), F.lit(False))), lambda x: x["i"]))
    out = out.withColumn("g", places)
    covered = F.aggregate("g", F.struct(F.lit(0).alias("n"), F.lit(0).alias("e")), lambda s, p: F.struct((s["n"] + p + _WINDOW - F.greatest(p, s["e"])).alias("n"), (p + _WINDOW).alias("e")), lambda s: s["n"])
    out = out.select(
        "d",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.when(~F.col("unspaced"), _share(F.col("word_chars"), F.col("n_words"))).alias("mean_word_chars"),
        _share(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        F.when(F.col("listed"), _share(F.col("n_stop"), F.col("n_words"))).alias("stop_ratio"),
        _share(F.col("n_letter"), F.col("n_words")).alias("letter_ratio"),
        _share(F.size("l") - F.size(F.array_distinct("l")), F.size("l")).alias("dup_line_ratio"),
    )
    return out


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, **options: object) -> DataFrame:
    """Every row of docs, as struct d, with its counts, ratios, base_failed, failed_rules and kept.

    base_failed: under 20 words, or over 30 % of the words repeated. kept: not base_failed and no rule of the
    table fails; a rule fails no text for which its ratio is null. Cases: null, empty and wordless texts have no words and fail the base; repeated rows get equal
    results; an empty table gives no rows; columns of docs may have any names, as they stay inside d.
    """
    out = with_counts(docs, text_col, **options)
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).withColumn("failed_rules", compiled(rules))
    # the partition's number keeps a later filter above these projections: pushed through them it would repeat every expression
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0) & (F.spark_partition_id() >= 0))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, lang_col: str = "lang", **options: object) -> DataFrame:
    """doc_id, the counts, base_failed, kept and failed_rules of every row of docs; the cases are those of judged()."""
    lang = [F.col(lang_col).alias("lang")] if lang_col in docs.columns else []
    out = judged(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *lang), "text", rules, **options)
    return out.select("d.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, **options: object) -> DataFrame:
    """The rows of docs that are kept, with their columns."""
    return judged(docs, text_col, rules, **options).where("kept").select("d.*")
