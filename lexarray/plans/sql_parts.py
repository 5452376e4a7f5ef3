"""SQL fragments that several queries share."""

from __future__ import annotations

from lexarray.functions.text import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

#: Tokens of documents before and after the filters.
RAW = r"""raw as (select doc_id, lang, text, list_filter(string_split_regex(coalesce(text, ''), '[\s\(\)\[\]\{\},;\.:\+\-\*\/\=\<\>\!\&\|\^\%\#\@\$\~\?]+'), lambda x: len(x) > 1) parts from documents),
exp as (select doc_id, lang, text, list_transform(flatten(list_transform(parts, lambda p: list_concat(list_concat([p],
    case when regexp_matches(p, '[_-]') then list_filter(string_split_regex(p, '[_-]'), lambda x: x <> '') else [] end),
    case when len(regexp_extract_all(p, '[a-z]+|[A-Z][a-z]*')) > 1 then list_transform(regexp_extract_all(p, '[a-z]+|[A-Z][a-z]*'), lambda x: lower(x)) else [] end))), lambda x: lower(x)) raw_terms from raw)"""
TOKENS = rf"""{RAW},
tok as (select doc_id, lang, text, list_filter(raw_terms, lambda t: len(t) > 2 and t not in ({_STOP}) and regexp_matches(t, '^[\p{{L}}\p{{N}}]+$') and not regexp_matches(t, '^\p{{Nd}}+$')) terms from exp)"""


def bm25(terms: dict[str, int], source: str = "tok", n: int = 10, language: str | None = None, name: str = "bm") -> str:
    values = ", ".join(f"('{t}', {k})" for t, k in sorted(terms.items()))
    where = f"where lang = '{language}'" if language else ""
    return f"""{name}_q(term, mult) as (values {values}),
{name}_d as (select doc_id, lang, cast(len(terms) as double) dl, terms from {source}),
{name}_n as (select count(*) n, avg(dl) avgdl from {name}_d),
{name}_tf as (select doc_id, lang, dl, term, mult, len(list_filter(terms, lambda t: t = term)) tf from {name}_d, {name}_q),
{name}_df as (select term, count(*) df from {name}_tf where tf > 0 group by term),
{name} as (select doc_id, sum(mult * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) score
  from (select * from {name}_tf where tf > 0) join {name}_df using (term), {name}_n {where} group by doc_id order by score desc, doc_id limit {n})"""


#: Distance of embedding rows e to a vector q, by metric; both sides in double precision.
DISTANCE = {
    "cosine": "1.0 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))",
    "l2": "list_distance(e, q)",
    "dot": "-list_dot_product(e, q)",
}
VECTORS = "v as (select vec_id, label, cast(embedding as double[]) e, (select cast(embedding as double[]) from embeddings where vec_id = 0) q from embeddings)"
