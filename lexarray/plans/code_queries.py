"""Queries that need a parser, a model or a stream, over files made from the tables; SQL says what they come to."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarray.operators import repository
from lexarray.operators.chunking import register
from lexarray.operators.chunking import syntactic_chunks as chunk
from lexarray.operators.embed import embedded
from lexarray.sources.corpus import chunks_from_documents, dealt, table
from lexarray.streaming.index import stream_index

PYTHON = '''import os
from typing import Any


class UserManager(BaseManager):
    """Keeps users."""

    def find(self, name: str, limit: int = 3) -> list:
        if name:
            for x in self.users:
                while x:
                    return x
        return []


async def fetch(url: str) -> bytes:
    """Gets a page."""
    return await get(url)
'''
JAVASCRIPT = """import x from 'y';
class Counter extends Base {
  add(n) { if (n > 0) { this.n += n; } return this.n; }
}
function greet(name) {
  return "hello {" + name;
}
"""


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files: a Python function, a JavaScript class with a method, text, or Python that cannot be parsed."""
    name = F.regexp_replace(F.lower("p_name"), "[^a-z]", "_")
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    python = F.format_string("import os\n\ndef %s(size: int, kind=1) -> %s:\n    '''%s.'''\n    if size:\n        return \"%s\" * size\n    elif kind:\n        return 2\n    return size", name, brand, F.col("p_type"), F.col("p_name"))
    script = F.format_string("// class No {\nclass %s extends Base {\n  %s(size) {\n    while (size) { size--; }\n    return `}${size}`;\n  }\n}", brand, name)
    kind = F.col("p_partkey") % 4
    return dealt(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey").select(
        F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("path"),
        F.when(kind.isin(0, 3), "python").when(kind == 1, "javascript").otherwise("text").alias("language"),
        F.when(kind == 0, python).when(kind == 1, script).when(kind == 2, F.col("p_name")).otherwise("def (").alias("content"),
    )


def syntactic_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk(_files(spark, sf)).select("file_path", "start_line", "end_line", "semantic_type", "content")


def code_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of every node, by the nested mode."""
    rows = chunk(_files(spark, sf), nested=True)
    return rows.select("file_path", "start_line", "semantic_type", "function_name", "class_name", "function_signature", "return_type", "docstring", F.element_at("parameter_types", 1).alias("first_type"), F.element_at("inheritance_chain", 1).alias("base"), "complexity_score")


def chunks_in_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The chunker as a table function in a lateral join, with counts by type."""
    register(spark)
    return spark.sql("select c.semantic_type, f.language, count(*) n, sum(length(c.content)) chars, sum(c.complexity_score) complexity from {files} f, lateral code_chunks(f.path, f.language, f.content) c group by 1, 2", files=_files(spark, sf))


def file_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """What each file imports and depends on, its lines, functions and classes."""
    files = _files(spark, sf)
    rows = repository.file_metadata(files, chunk(files))
    return rows.withColumns({c: F.array_join(c, "|") for c in ("imports", "dependencies")})


def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The signs of the default model's vectors, which are those of whole numbers."""
    rows = embedded(chunks_from_documents(table(spark, sf, "documents")))
    return rows.select("rowid", F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "+").when(x < 0, "-").otherwise("0")), "").alias("signs"))


def streaming_index(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream of files, indexed by line windows into a folder of the warehouse."""
    base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), f"stream-{uuid.uuid4()}")
    source = table(spark, sf, "documents")
    source.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{base}/in")
    files = stream.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), F.sha2("text", 256).alias("file_hash"))
    stream_index(files, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("file_path", "start_line", "end_line")


def queries() -> dict:
    return {f.__name__: f for f in (syntactic_chunks, code_metadata, chunks_in_sql, file_metadata, embed_chunks, streaming_index)}


_PARTS = r"""p as (select p_partkey % 4 kind, 'part/' || p_partkey file_path, regexp_replace(lower(p_name), '[^a-z]', '_', 'g') f, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') b, p_type t, p_name n, chr(10) nl from part),
c as (select *, case kind when 0 then concat_ws(nl, '', 'def ' || f || '(size: int, kind=1) -> ' || b || ':', '    ''''''' || t || '.''''''', '    if size:', '        return "' || n || '" * size', '    elif kind:', '        return 2', '    return size')
  else concat_ws(nl, '// class No {', 'class ' || b || ' extends Base {', '  ' || f || '(size) {', '    while (size) { size--; }', '    return `}${size}`;', '  }', '}') end as content from p where kind < 2)"""
_META = """select file_path, 1 start_line, 'import_statement' semantic_type, null function_name, null class_name, null function_signature, null return_type, null docstring, null first_type, null base, null complexity_score from p where kind = 0
union all select file_path, 2, 'function_definition', f, null, 'def ' || f || '(size: int, kind=1) -> ' || b, b, t || '.', 'int', null, 2 from p where kind = 0
union all select file_path, 1, 'class_declaration', null, b, null, null, null, null, 'Base', null from p where kind = 1
union all select file_path, 2, 'method_definition', f, null, f || '(size)', null, null, null, null, 2 from p where kind = 1
union all select file_path, 1, 'code_block', null, null, null, null, null, null, null, null from p where kind = 3"""
#: crc32 of each different word: a step for each byte, then one for each of its bits.
_STEPS = "list_concat([cast(4294967295 as bigint)], flatten(list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda i: list_concat([cast('0x' || substr(hex(encode(w)), i, 2) as bigint)], [cast(-1 as bigint) for y in range(8)]))))"
_SIGNS = rf"""d as (select doc_id, list_filter(string_split_regex(lower('text: ' || coalesce(text, '')), '\s+'), lambda x: x <> '') ws from documents),
u as (select doc_id, unnest(ws) w from d),
h as (select w, xor(4294967295, list_reduce({_STEPS}, lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end)) h from (select distinct w from u)),
s as (select doc_id, h % 64 k, sum(case when h >= 2147483648 then 1 else -1 end) s from u join h using (w) group by doc_id, h % 64),
g as (select doc_id as rowid, unnest(range(64)) k from documents)"""


def oracle_sql() -> dict[str, str]:
    return {
        "syntactic_chunks": f"with {_PARTS} select file_path, cast(2 - kind as int) start_line, cast(9 - 2 * kind as int) end_line, case kind when 0 then 'function_definition' else 'class_declaration' end semantic_type, content from c",
        "code_metadata": f"with {_PARTS} {_META}",
        "chunks_in_sql": f"with {_PARTS} select case kind when 0 then 'function_definition' else 'class_declaration' end semantic_type, case kind when 0 then 'python' else 'javascript' end as language, count(*) n, cast(sum(len(content)) as bigint) chars, cast(case kind when 0 then 2 * count(*) end as bigint) complexity from c group by kind",
        "file_metadata": "select 'part/' || p_partkey file_path, case p_partkey % 4 when 1 then 'javascript' when 2 then 'text' else 'python' end as language, case p_partkey % 4 when 0 then 'import os' end imports, case p_partkey % 4 when 0 then 'os' end dependencies, cast(case p_partkey % 4 when 0 then 9 when 1 then 7 else 1 end as int) total_lines, cast(p_partkey % 4 = 0 as bigint) total_functions, cast(p_partkey % 4 = 1 as bigint) total_classes from part",
        "embed_chunks": f"with {_SIGNS} select rowid, string_agg(case when s > 0 then '+' when s < 0 then '-' else '0' end, '' order by g.k) signs from g left join s on s.doc_id = rowid and s.k = g.k group by rowid",
        "streaming_index": r"with l as (select source || '/' || doc_id file_path, string_split(text, chr(10)) l from documents), w as (select file_path, l, unnest(range(0, len(l), 12)) a from l) select file_path, cast(a + 1 as int) start_line, cast(least(a + 15, len(l)) as int) end_line from w where regexp_matches(array_to_string(l[a + 1:a + 15], chr(10)), '[^\s]')",
    }
