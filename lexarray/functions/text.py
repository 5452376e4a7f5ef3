"""Code-aware text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never become tokens, and each language's own.
STOP_WORDS = (
    "the and or but in on at to for of with by if else elif while def class import from as try except finally pass break continue return function var let const new this super "
    "extends implements public private protected static abstract final override"
).split()
LANGUAGE_WORDS = {
    "python": "def class if else elif while for try except finally with as import from".split(),
    "javascript": "function var let const if else while for try catch finally class extends".split(),
    "typescript": "function var let const if else while for try catch finally class extends interface type".split(),
    "java": "public private protected static final abstract class interface extends implements if else while for try catch".split(),
    "go": "func var const type struct interface if else for switch case default go defer".split(),
    "rust": "fn let mut const struct enum trait impl if else while for match loop".split(),
}
#: Delimiters between tokens, and the parts of a camel-case name.
DELIMITERS = r"[\s\(\)\[\]\{\},;\.:\+\-\*\/\=\<\>\!\&\|\^\%\#\@\$\~\?]+"
CAMEL = r"[a-z]+|[A-Z][a-z]*"
_QUOTED = [r'"[^"]*"', r"'[^']*'"]
_SLASHED = [r"(?m)//.*$", r"(?s)/\*.*?\*/"]
#: What is taken out before tokenising, in this order.
STRIPPED = {
    "python": [r"(?m)#.*$", r'(?s)""".*?"""', r"(?s)'''.*?'''", *_QUOTED],
    "javascript": [*_SLASHED, *_QUOTED, r"`[^`]*`"],
    "typescript": [*_SLASHED, *_QUOTED, r"`[^`]*`"],
    "java": [*_SLASHED, _QUOTED[0]],
    "go": [*_SLASHED, _QUOTED[0], r"`[^`]*`"],
    "rust": [*_SLASHED, _QUOTED[0]],
}


def strip_comments(content: Column, language: str | None) -> Column:
    """content without comments and string literals of a language; unknown languages are left as they are."""
    for pattern in STRIPPED.get(language or "", ()):
        content = F.regexp_replace(content, pattern, "")
    return content


def split_identifier(name: Column) -> Column:
    """The name itself, its parts between _ and -, and its camel-case parts in small letters if there are several."""
    none = F.array().cast("array<string>")
    snake = F.when(name.rlike("[_-]"), F.filter(F.split(name, "[_-]"), lambda x: x != "")).otherwise(none)
    camel = F.regexp_extract_all(name, F.lit(f"({CAMEL})"), F.lit(1))
    return F.concat(F.array(name), snake, F.when(F.size(camel) > 1, F.transform(camel, F.lower)).otherwise(none))


def raw_tokens(content: Column, language: str | None = None) -> Column:
    parts = F.filter(F.split(strip_comments(F.coalesce(content, F.lit("")), language), DELIMITERS), lambda x: F.length(x) > 1)
    return F.transform(F.flatten(F.transform(parts, split_identifier)), F.lower)


def tokens(content: Column, language: str | None = None) -> Column:
    """Search tokens of a text: identifiers split, stop words, short ones and numbers left out; order and repeats kept."""
    stop = sorted({*STOP_WORDS, *LANGUAGE_WORDS.get(language or "", ())})
    return F.filter(raw_tokens(content, language), lambda t: (F.length(t) > 2) & ~t.isin(stop) & t.rlike(r"^[\p{L}\p{N}]+$") & ~t.rlike(r"^\p{Nd}+$"))


def like(column: Column, pattern: str) -> Column:
    """A case-insensitive search in which % and _ of the pattern are live wildcards and nothing escapes them."""
    return column.ilike("%" + pattern.replace("\\", "\\\\") + "%")


def json_array(values: Column) -> Column:
    """The text form a list of plain strings is searched in."""
    return F.when(F.size(values) > 0, F.concat(F.lit('["'), F.array_join(values, '", "'), F.lit('"]')))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\b\w+\b)"), F.lit(1)))
