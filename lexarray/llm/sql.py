"""DuckDB SQL for the queries whose results SQL can express."""

from __future__ import annotations

from lexarray.llm.quality import RULES, STOP_WORDS, UNSPACED

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


OP1 = rf"""
with d as (select doc_id, row_number() over () rid, regexp_extract_all({_lowered("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all({_lowered("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark where item_id is not null),
win as (select distinct item_id, least(13, len(w)) size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') words
        from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) i from b where len(w) > 0)),
pos as (select rid, w, unnest(range(1, len(w) + 1)) i from d),
sized as (select rid, i, size, array_to_string(w[i:i + size - 1], ' ') words from pos, (select distinct size from win) where i + size - 1 <= len(w)),
m as (select distinct rid, i, sized.size, item_id from sized join win using (size, words)),
hit as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + size)) p from m) group by rid),
items as (select rid, count(distinct item_id) n, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) s from m group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(hit.n, 0) as bigint) n_hit, cast(coalesce(items.n, 0) as bigint) n_items, sha256(coalesce(s, '')) items_sha256,
  coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(w) contaminated
from d left join hit using (rid) left join items using (rid)"""

_STOP = ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))
_METRIC = {
    "mean_word_chars": "case when n_words = 0 then 0 when 2 * n_unspaced <= word_chars then word_chars / n_words end",
    "symbol_ratio": "case when n_words > 0 then n_symbols / n_words else 0 end",
    "stop_ratio": f"case when lower(split_part(lang, '-', 1)) not in ({', '.join(map(repr, STOP_WORDS))}) then null when lang is null then null when n_words > 0 then n_stop / n_words else 0 end",
    "letter_ratio": "case when n_words > 0 then n_letter / n_words else 0 end",
    "dup_line_ratio": "case when n_lines > 0 then n_dup_lines / n_lines else 0 end",
}
_BAD = ", ".join(f"case when {' or '.join([f'({_METRIC[r.metric]}) < {r.low}'] * (r.low is not None) + [f'({_METRIC[r.metric]}) > {r.high}'] * (r.high is not None))} then '{r.name}' end" for r in RULES)

#: The rows and columns of the quality rules over a relation src(doc_id, text, lang), keyed by rid.
_OP4 = rf"""
q0 as (select src.*, row_number() over () rid from src),
q1 as (select rid, lang, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from q0),
q2 as (select rid, i, array_to_string(w[i:i + 7], ' ') g from (select rid, w, unnest(range(1, len(w) - 6)) i from q1)),
q3 as (select rid, i from q2 qualify count(*) over (partition by rid, g) > 1),
q4 as (select rid, count(distinct p) n from (select rid, unnest(range(i, i + 8)) p from q3) group by rid),
q5 as (select q1.rid, lang, len(regexp_extract_all(t, '[{"".join(chr(92) + "p{" + x + "}" for x in UNSPACED)}]')) n_unspaced, len(w) n_words, len(array_to_string(w, '')) word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols, len(l) n_lines,
  len(l) - len(list_distinct(l)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(list_filter(w, lambda x: lower(x) in ({_STOP}))) n_stop, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) n_letter
  from q1 left join q4 using (rid)),
q6 as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed, list_filter([{_BAD}], lambda x: x is not null) failed from q5),
q7 as (select q0.* exclude (rid), q6.* exclude (rid, lang), not base_failed and len(failed) = 0 kept from q0 join q6 using (rid))"""

OP4 = f"""with src as (select * from documents),{_OP4}
select doc_id, cast(n_words as bigint) n_words, cast(word_chars as bigint) word_chars, cast(n_symbols as bigint) n_symbols, cast(n_dup_lines as bigint) n_dup_lines, cast(n_repeat_words as bigint) n_repeat_words,
  base_failed, kept, array_to_string(failed, ',') failed_rules from q7"""

OP6 = """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
h as (select page_id, octet_length(b) n, sha1(b) x from p),
d as (select page_id, n, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(x, 1 + 10 * (i // 8), 10) as bigint) >> (35 - 5 * (i % 8))) & 31) as int), 1)), '') s from h),
m as (select *, min(page_id) over (partition by n, s) f from d)
select page_id, cast(n as bigint) payload_bytes, s payload_digest, case when f is not null and page_id is distinct from f then 'revisit' else 'response' end record_type,
  case when page_id is distinct from f then f end refers_to from m"""

OP10 = rf"""
with recursive d as (select doc_id, row_number() over () rid, regexp_extract_all({_lowered("text")}, '[^\x20\x09-\x0D]+') w from documents),
sh as (select rid, doc_id, list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(len(w) - 4, 1) + 1)]) s from d where len(w) > 0),
u as (select rid, doc_id, len(s) n, unnest(s) g from sh),
pairs as (select a.rid a, b.rid b from u a join u b using (g) where a.rid < b.rid group by a.rid, b.rid, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
paired as (select a, b from pairs union select b, a from pairs),
reach(a, b) as (select rid, rid from sh union select reach.a, paired.b from reach join paired on reach.b = paired.a),
comp as (select reach.a rid, min(sh.doc_id) c from reach join sh on sh.rid = reach.b group by reach.a)
select doc_id, cast(coalesce(len(s), 0) as bigint) n_shingles, coalesce(c, doc_id) component_id from d left join (select rid, s from sh) using (rid) left join comp using (rid)"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, levels: int) -> str:
    """Relations {name}0 to {name}{levels} of the nodes (g, i, h, n: how many of the level) above {name}0, with the digests a and b beside each."""
    out = ""
    for k in range(levels):
        beside = [f"coalesce(string_agg(h, '') over (partition by g, i // 8 order by i rows between {rows}), '') {side}" for side, rows in (("a", "unbounded preceding and 1 preceding"), ("b", "1 following and unbounded following"))]
        out += f""",
{name}w{k} as materialized (select g, i, n, {", ".join(beside)} from {name}{k}),
{name}{k + 1} as materialized (select g, i // 8 i, case when any_value(n) = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end h, (any_value(n) + 7) // 8 n from {name}{k} group by g, i // 8)"""
    return out


def _path(rows: str, name: str, levels: int) -> str:
    """rows (g, i, f: a digest, s: digests beside its path) with f and s carried up the tree."""
    for k in range(levels):
        rows = f"(select r.* exclude (f, s), case when w.n = 1 then f else sha256(a || f || b) end f, case when w.n = 1 then s else s || a || b end s from {rows} r join {name}w{k} w on w.g = r.g and w.i = r.i >> {3 * k})"
    return rows


#: crc32 of the digits of an id: a step for each byte, then one for each of its bits.
_CRC = "xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(doc_id as varchar), ''), lambda x: list_concat([cast(ascii(x) as bigint)], [cast(-1 as bigint) for y in range(8)])))), lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end))"

#: Levels for 8**8 documents of a language, and 8**3 languages.
OP11 = f"""
with o as materialized (select doc_id, coalesce('=' || lang, '') g, {_leaf("text")} leaf, {_leaf(f"case when {_CRC} % 3 = 0 then translate(text, '{_UPPER}', '{_LOWER}') else text end")} shown from documents),
l as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by g) n from o),
t0 as (select g, i, leaf h, n from l){_tree("t", 8)},
u0 as (select '' g, row_number() over (order by g) - 1 i, h, count(*) over () n, g lang from t8){_tree("u", 3)},
p as (select doc_id, leaf, g lang, f, s from {_path("(select doc_id, leaf, g, i, shown f, '' s from l)", "t", 8)} x),
q as (select p.*, u0.h subroot, '' g, u0.i from p join u0 using (lang))
select doc_id, leaf, subroot, h as root, sha256(s) proof_sha256, f folded_root, f = h verified from {_path("q", "u", 3)} x, (select h from u3) y"""


def _round(k: int) -> str:
    """The vectors by their nearest centroid of round k, and the centroids after it."""
    return f"""
a{k} as materialized (select rid, any_value(q.v) v, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))), 'c': c.c}}) m from q, c{k} c group by rid),
s{k} as (select m.c c, j, sum(v[j]) s, count(*) n from a{k}, (select unnest(range(1, 65)) j) group by m.c, j),
c{k + 1} as materialized (select c, coalesce(m.v, c{k}.v) v from c{k} left join (select c, list(cast((s - (s % n + n) % n) // n as bigint) order by j) v from s{k} group by c) m using (c))"""


OP12 = f"""
with q as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select cast(row_number() over (order by h nulls last, v) - 1 as int) c, v from (select sha256('3:' || vec_id) h, v from q order by h nulls last, v limit 8)),{",".join(map(_round, range(10)))},
f as (select rid, m.c c, cast(m.d as bigint) d from (select rid, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]))), 'c': c.c}}) m from q, c10 c group by rid))
select vec_id, f.c as cluster, d as distance, cast(sum(d) over (partition by f.c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(c10.v, ',')) centroid_sha256
from f join q using (rid) join c10 on c10.c = f.c"""
