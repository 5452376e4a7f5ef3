"""Syntactic chunks with metadata: Python by its own parser, brace languages by braces.declarations().

A parsed file is a tree of nodes; nodes of chunkable types become chunks if they are small enough, larger ones
are split among their children, and short neighbours are merged. Runs as one Arrow map over files.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from lexarray.operators.braces import declarations

#: Characters of a chunk at most, of one that is merged with the next, and of a merged one at most.
MOST, LEAST, MERGED = 600, 100, 800
#: Node types that become chunks.
CHUNKABLE = set("function_definition async_function_definition method_definition class_definition class_declaration interface_declaration constructor_definition struct_declaration enum_declaration type_alias_declaration variable_declaration const_declaration function_declaration".split())
#: Which type names a group of nodes, and which a merged chunk; others count 1.
PRIORITY = {"import_statement": 2, "import_declaration": 2, "class_definition": 10, "class_declaration": 10, "function_definition": 8, "async_function_definition": 8, "method_definition": 7, "constructor_definition": 7, "interface_declaration": 6, "struct_declaration": 6, "variable_declaration": 4, "const_declaration": 4}
MERGE_PRIORITY = {"class_definition": 10, "function_definition": 8, "method_definition": 7, "variable_declaration": 4}
#: Types of which chunks of two different ones are never merged.
DISTINCT = {"function_definition", "class_definition", "interface_declaration", "method_definition", "constructor_definition"}
#: Types that the nested mode extracts, and how much each says about a text.
NESTED = {
    "class_definition": 10, "class_declaration": 10, "interface_declaration": 10, "function_definition": 8, "async_function_definition": 8, "function_declaration": 8, "method_definition": 7, "constructor_definition": 7,
    "struct_declaration": 6, "enum_declaration": 6, "type_alias_declaration": 6, "variable_declaration": 4, "const_declaration": 4, "let_declaration": 4, "import_statement": 2, "import_declaration": 2, "from_import_statement": 2,
}
FIELDS = ("function_name", "class_name", "function_signature", "return_type", "docstring")
SCHEMA = "file_path string, content string, start_line int, end_line int, semantic_type string, " + ", ".join(f"{f} string" for f in FIELDS) + ", parameter_types array<string>, inheritance_chain array<string>, decorators array<string>, interfaces array<string>, import_statements array<string>, dependencies array<string>, complexity_score int"


@dataclass
class Node:
    kind: str
    first: int
    last: int
    meta: dict = field(default_factory=dict)
    children: list = field(default_factory=list)


class _Source:
    """A Python file's lines, for pieces of it by the positions of its syntax tree."""

    def __init__(self, text: str) -> None:
        self.lines = [x.encode() for x in re.split(r"(?<=\n)|(?<=\r)(?!\n)", text)]

    def piece(self, n: ast.AST) -> str:
        lines = self.lines[n.lineno - 1 : n.end_lineno]
        lines[-1] = lines[-1][: n.end_col_offset]
        lines[0] = lines[0][n.col_offset :]
        return b"".join(lines).decode()

    def starts(self, n: ast.AST, word: bytes) -> bool:
        return self.lines[n.lineno - 1].startswith(word, n.col_offset)


#: Statements that count for complexity once each, cases of a match and conditional expressions too; an elif belongs to its if.
_DECISIONS = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.TryStar, ast.IfExp, ast.match_case)


def _docstring(n: ast.AST, source: _Source) -> str | None:
    """The first string of a body as it stands, without triple quotes."""
    first = n.body[0] if n.body else None
    if not (isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str)):
        return None
    return source.piece(first.value).strip().replace('"""', "").replace("'''", "")


def _python_meta(n: ast.AST, source: _Source) -> dict:
    if isinstance(n, ast.ClassDef):
        return {"class_name": n.name, "inheritance_chain": [b.id for b in n.bases if isinstance(b, ast.Name)], "docstring": _docstring(n, source), "decorators": [ast.unparse(d) for d in n.decorator_list]}
    a = n.args
    plain = [*a.posonlyargs, *a.args]
    args = plain[: len(plain) - len(a.defaults)] + [x for x, d in zip(a.kwonlyargs, a.kw_defaults) if d is None]  # typed defaults do not count
    returns = ast.unparse(n.returns) if n.returns else None
    return {
        "function_name": n.name,
        "function_signature": f"def {n.name}({ast.unparse(a)})" + (f" -> {returns}" if returns else ""),
        "parameter_types": [ast.unparse(x.annotation) for x in args if x.annotation],
        "return_type": returns,
        "docstring": _docstring(n, source),
        "decorators": [ast.unparse(d) for d in n.decorator_list],
        "complexity_score": 1 + sum(isinstance(x, _DECISIONS) and not (isinstance(x, ast.If) and source.starts(x, b"elif")) for x in ast.walk(n)),
    }


def parse_python(text: str) -> list[Node]:
    source = _Source(text)

    def nodes(body: list) -> list[Node]:
        out = []
        for n in body:
            kind = {ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "async_function_definition", ast.ClassDef: "class_definition", ast.Import: "import_statement", ast.ImportFrom: "import_from_statement"}.get(type(n), "statement")
            inner = [x for name in ("body", "orelse", "finalbody", "handlers") for x in getattr(n, name, []) if isinstance(getattr(n, name), list)]
            out.append(Node(kind, n.lineno, n.end_lineno, _python_meta(n, source) if kind.endswith("definition") else {}, nodes(inner)))
        return out

    return nodes(ast.parse(text).body)


def parse_braces(text: str, language: str = "javascript") -> list[Node]:
    """Nodes from the first line of a declaration to that of its closing brace; complexity is counted for scripts only."""
    roots: list[Node] = []
    stack: list[tuple[Node, int]] = []
    for d, first, last in declarations(text, language):
        if d.kind == "class_declaration":
            meta = {"class_name": d.name, "inheritance_chain": d.bases, "interfaces": d.interfaces}
        else:
            meta = {"function_name": d.name, "function_signature": d.signature, "parameter_types": d.types, "return_type": d.returns, "complexity_score": 1 + d.branches if language in ("javascript", "typescript") else None}
        node = Node(d.kind, first, last, meta)
        while stack and stack[-1][1] <= d.start:
            stack.pop()
        (stack[-1][0].children if stack else roots).append(node)
        stack.append((node, d.end))
    return roots


def _size(lines: list[str], a: int, b: int) -> int:
    return len(re.sub(r"\s", "", "".join(lines[a - 1 : b])))


def _chunk(lines: list[str], kind: str, first: int, last: int, meta: dict) -> dict:
    a, b = max(0, first - 2), min(len(lines), last + 1)  # one line before and after
    return {"content": "\n".join(lines[a:b]), "start_line": a + 1, "end_line": b, "semantic_type": kind, **meta}


def _extract(lines: list[str], node: Node) -> Iterator[dict]:
    if node.kind not in CHUNKABLE:
        for c in node.children:
            yield from _extract(lines, c)
    elif _size(lines, node.first, node.last) <= MOST or not node.children:
        yield _chunk(lines, node.kind, node.first, node.last, node.meta)
    else:
        for group in _grouped(lines, node.children):
            if len(group) == 1:
                yield from _extract(lines, group[0])
            else:
                yield _chunk(lines, _dominant(group), group[0].first, max(n.last for n in group), {})


def _grouped(lines: list[str], children: list[Node]) -> Iterator[list[Node]]:
    """Children in groups that fit a chunk; one that does not fit is a group of its own."""
    group: list[Node] = []
    total = 0
    for c in children:
        n = _size(lines, c.first, c.last)
        if group and (n > MOST or total + n > MOST):
            yield group
            group, total = [], 0
        if n > MOST:
            yield [c]
        else:
            group.append(c)
            total += n
    if group:
        yield group


def _dominant(group: list[Node]) -> str:
    """The kind that says most, the first of equals; kinds without a priority count 1."""
    return max(group, key=lambda x: PRIORITY.get(x.kind, 1)).kind if group else "code_block"


def _merged(lines: list[str], a: dict, b: dict) -> dict | None:
    """Two chunks as one, cut from the file anew, if they are near, small enough and not of different distinct types."""
    x, y = a["semantic_type"], b["semantic_type"]
    first, last = min(a["start_line"], b["start_line"]), max(a["end_line"], b["end_line"])
    text = "\n".join(lines[first - 1 : last])
    if (x in DISTINCT and y in DISTINCT and x != y) or abs(a["end_line"] - b["start_line"]) > 3 or len(text) > MERGED:
        return None
    kind = x if x == y or MERGE_PRIORITY.get(x, 1) >= MERGE_PRIORITY.get(y, 1) else y
    return {"content": text, "start_line": first, "end_line": last, "semantic_type": kind} | {f: a.get(f) or b.get(f) for f in ("function_name", "class_name", "function_signature", "docstring")}


def _parsed(text: str, language: str) -> list[Node]:
    try:
        return parse_python(text) if language == "python" else parse_braces(text, language)
    except (SyntaxError, ValueError, RecursionError):
        return []


def chunks_of(text: str, language: str) -> list[dict]:
    """The chunks of one file; none where it cannot be parsed."""
    lines = text.split("\n")
    found = [c for n in _parsed(text, language) for c in _extract(lines, n)]
    out, i = [], 0
    while i < len(found):
        both = _merged(lines, found[i], found[i + 1]) if len(found[i]["content"]) < LEAST and i + 1 < len(found) else None
        out.append(both or found[i])
        i += 2 if both else 1
    return out


def _walk(nodes: list[Node]) -> Iterator[Node]:
    for n in nodes:
        yield n
        yield from _walk(n.children)


def nested_chunks_of(text: str, language: str) -> list[dict]:
    """A chunk for every node of a type that says something, inner ones besides those around them; the whole text as
    one block where there is none."""
    lines = text.split("\n")
    found = [_chunk(lines, n.kind, n.first, n.last, n.meta) for n in _walk(_parsed(text, language)) if n.kind in NESTED]
    return found or [{"content": text, "start_line": 1, "end_line": len(lines), "semantic_type": "code_block"}]


def semantic_type_of(text: str, language: str) -> str:
    """The type in a text that says most, the first of equals; code_block where there is none."""
    kinds = [n.kind for n in _walk(_parsed(text, language)) if n.kind in NESTED]
    return max(kinds, key=NESTED.__getitem__) if kinds else "code_block"


_IMPORTS = {
    "python": lambda x: x.startswith(("import ", "from ")),
    "java": lambda x: x.startswith("import "),
    "rust": lambda x: x.startswith("use "),
    "go": lambda x: x.startswith("import ") or (x.startswith('"') and "/" in x),
    "javascript": lambda x: x.startswith("import ") or (x.startswith("const ") and "require(" in x),
}
_IMPORTS["typescript"] = _IMPORTS["javascript"]


def imports_of(text: str, language: str) -> list[str]:
    """The lines of a file that import; every chunk of it carries them."""
    return [x for x in map(str.strip, text.split("\n")) if language in _IMPORTS and _IMPORTS[language](x)]


def dependencies_of(imports: list[str], language: str) -> list[str]:
    """The modules that import lines name, each once."""
    found = []
    for x in imports:
        if language == "python":
            m = re.match(r"(?:import\s+|from\s+)([^\s.]+)", x)
            found.append(m[1] if m else None)
        elif language in ("javascript", "typescript"):
            m = re.search(r"""from\s+['"]([^'"]+)['"]""", x) or re.search(r"""require\(\s*['"]([^'"]+)['"]""", x)
            found.append(m[1] if m else None)
    return list(dict.fromkeys(x for x in found if x))


PARSED = ("python", "javascript", "typescript", "java", "go", "rust")


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _arrow_schema() -> pa.Schema:
    lists = ("parameter_types", "inheritance_chain", "decorators", "interfaces", "import_statements", "dependencies")
    kinds = dict.fromkeys(lists, pa.list_(pa.string())) | dict.fromkeys(("start_line", "end_line", "complexity_score"), pa.int32())
    return pa.schema([(n, kinds.get(n, pa.string())) for n in _NAMES])


def file_rows(path: str, language: str, text: str | None, chunker: Callable[[str, str], list[dict]]) -> Iterator[dict]:
    """A file's chunks as rows of SCHEMA; empty values are null."""
    imports = imports_of(text or "", language)
    shared = {"file_path": path, "import_statements": imports, "dependencies": dependencies_of(imports, language)}
    for c in chunker(text or "", language):
        row = shared | c
        yield {n: row.get(n) or None for n in _NAMES}


def syntactic_chunks(files: DataFrame, nested: bool = False) -> DataFrame:
    """Chunks of files (path, language, content) with their metadata; files of unparsed languages give none here.

    nested: every node of a telling type is a chunk, inner ones too, and a file without any is one block.
    """
    chunker = nested_chunks_of if nested else chunks_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in file_rows(path, language, text, chunker)]
            yield pa.RecordBatch.from_pylist(rows, _arrow_schema())

    return files.where(F.col("language").isin(*PARSED)).select("path", "language", "content").mapInArrow(run, SCHEMA)


@udtf(returnType=SCHEMA)
class CodeChunks:
    """A table function: code_chunks(path, language, content) gives the chunks of one file, in SQL by a lateral join."""

    def eval(self, path: str, language: str, content: str) -> Iterator[tuple]:
        if language in PARSED:
            for r in file_rows(path, language, content, chunks_of):
                yield tuple(r.values())


def register(spark: SparkSession) -> None:
    """Makes code_chunks known to SQL."""
    spark.udtf.register("code_chunks", CodeChunks)
