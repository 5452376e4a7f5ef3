"""Graphs of chunks, imports and inheritance as node and edge tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared checkpoint folder, so that a round's plan does not grow with the rounds."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_checkpoints"))
    return df.checkpoint()


#: How each language's imports are found in a text.
IMPORTS = {
    "python": [r"(?m)^\s*import\s+([A-Za-z_][\w.]*)", r"(?m)^\s*from\s+([A-Za-z_][\w.]*)\s+import"],
    "javascript": [r"import[^'\"]*from\s+['\"]([^'\"]+)['\"]", r"require\(\s*['\"]([^'\"]+)['\"]\s*\)"],
    "go": [r"(?m)^\s*import\s+\"([^\"]+)\"", r"(?m)^\s+\"([^\"]+)\"\s*$"],
    "c": [r"(?m)#include\s+\"([^\"]+)\"", r"(?m)#include\s+<([^>]+)>"],
}
#: Names that look like calls and are none.
NOT_CALLS = "if while for try catch with super print len str int float".split()


def imports(content: Column, language: str) -> Column:
    found = F.array().cast("array<string>")
    for pattern in IMPORTS.get("javascript" if language == "typescript" else language, ()):
        found = F.concat(found, F.regexp_extract_all(content, F.lit(pattern), F.lit(1)))
    return F.array_distinct(found)


def import_lines(content: Column, language: str) -> Column:
    """The lines that import, in order; null if there are none."""
    x = lambda p: lambda s: s.startswith(p)
    tests = {
        "python": lambda s: s.startswith("import ") | s.startswith("from "),
        "java": x("import "),
        "rust": x("use "),
        "go": lambda s: s.startswith("import ") | (s.startswith('"') & s.contains("/")),
    }
    tests["javascript"] = tests["typescript"] = lambda s: s.startswith("import ") | (s.startswith("const ") & s.contains("require("))
    lines = F.filter(F.transform(F.split(content, "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), tests[language])
    return F.when(F.size(lines) > 0, lines)


def calls(content: Column, dollar: bool = False) -> Column:
    """Distinct names called in a text, longer than two characters and no keywords."""
    name = r"\b([a-zA-Z_$][\w$]*)\s*\(" if dollar else r"\b([a-zA-Z_]\w*)\s*\("
    return F.array_distinct(F.filter(F.regexp_extract_all(content, F.lit(name), F.lit(1)), lambda x: (F.length(x) > 2) & ~x.isin(NOT_CALLS)))


def module_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files, functions and classes: one node an id, one `contains` edge a chunk."""
    file_id = F.concat(F.lit("file:"), F.col("file_path"))
    parts = [(k, F.col(f"{k}_name"), F.concat_ws(":", F.lit(k), "file_path", F.col(f"{k}_name"))) for k in ("function", "class")]
    nodes = chunks.select(file_id.alias("id"), F.lit("file").alias("type"), F.col("file_path").alias("name")).distinct()
    edges = None
    for kind, name, key in parts:
        own = chunks.where(name.isNotNull())
        nodes = nodes.unionByName(own.select(key.alias("id"), F.lit(kind).alias("type"), name.alias("name")).distinct())
        e = own.select(file_id.alias("source"), key.alias("target"), F.lit("contains").alias("relationship"))
        edges = e if edges is None else edges.unionByName(e)
    if "inheritance_chain" in chunks.columns:
        classes = nodes.where("type = 'class'").groupBy("name").agg(F.min("id").alias("target"))
        child = chunks.where("class_name is not null").select(parts[1][2].alias("source"), F.explode("inheritance_chain").alias("name"))
        edges = edges.unionByName(child.join(classes, "name").select("source", "target", F.lit("inherits").alias("relationship")))
    return nodes, edges


def neighbours(nodes: DataFrame, edges: DataFrame, start: str, relationship: str | None = None) -> DataFrame:
    out = edges.where(F.col("source") == start)
    if relationship:
        out = out.where(F.col("relationship") == relationship)
    return out.select(F.col("target").alias("id")).join(nodes, "id")


def neighbourhood(nodes: DataFrame, edges: DataFrame, start: str, radius: int) -> DataFrame:
    """Ids within radius steps of start in either direction, with their distance; none if start is no node."""
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    found = nodes.where(F.col("id") == start).select("id", F.lit(0).alias("distance"))
    edge = found
    for step in range(1, radius + 1):
        edge = edge.join(both, F.col("id") == F.col("source")).select(F.col("target").alias("id")).distinct().join(found.select("id"), "id", "left_anti").withColumn("distance", F.lit(step))
        found = found.unionByName(edge)
    return found


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str) -> list[str]:
    """The ids of a shortest directed path, the smallest of several; empty if there is none.

    Breadth first until the goal or nothing new is found: each round joins only the frontier, and keeps one path a node.
    """
    if start == goal:
        return [start] if not nodes.where(F.col("id") == start).isEmpty() else []
    hops = edges.select("source", "target").distinct()
    frontier = nodes.where(F.col("id") == start).select("id", F.array("id").alias("path"))
    seen = frontier.select("id")
    while True:
        step = frontier.join(hops, F.col("id") == F.col("source")).select(F.col("target").alias("id"), F.concat("path", F.array("target")).alias("path"))
        frontier = cut(step.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        hit = frontier.where(F.col("id") == goal).select("path").first()
        if hit:
            return list(hit[0])
        if frontier.isEmpty():
            return []
        seen = seen.unionByName(frontier.select("id"))


def ancestors(pairs: DataFrame) -> DataFrame:
    """(root, ancestor, depth, path) along (child, parent) pairs; a name already on the path ends it."""
    level = pairs.select(F.col("child").alias("root"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"), F.array("child", "parent").alias("path"))
    out = level
    up = pairs.select(F.col("child").alias("c"), F.col("parent").alias("p"))
    while True:
        level = cut(level.join(up, F.col("ancestor") == F.col("c")).where(~F.array_contains("path", F.col("p"))).select("root", F.col("p").alias("ancestor"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("p")).alias("path")))
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def resolve(imported: DataFrame, files: DataFrame) -> DataFrame:
    """(dependent, module, dep_path): of the files a dotted module can mean the first that exists; relative ones are skipped."""
    m = F.col("module")
    forms = [F.concat(F.replace(m, F.lit("."), F.lit("/")), F.lit(".py")), *[F.concat(m, F.lit(x)) for x in (".py", ".js", ".ts", ".go")]]
    tried = imported.where(~m.startswith(".")).select("dependent", "module", F.posexplode(F.array(*forms)).alias("priority", "dep_path"))
    found = tried.join(files.select(F.col("path").alias("dep_path")).distinct(), "dep_path")
    return found.groupBy("dependent", "module").agg(F.min_by("dep_path", "priority").alias("dep_path"))


def impact(edges: DataFrame, changed: DataFrame, depth: int = 1) -> DataFrame:
    """Changed paths and those that depend on them, directly or over `depth` steps, by (dep_path, dependent)."""
    out = edge = changed.select("path").distinct()
    for _ in range(depth):
        edge = edge.join(edges, F.col("path") == F.col("dep_path")).select(F.col("dependent").alias("path")).distinct()
        out = out.unionByName(edge).distinct()
    return out


def context_window(chunks: DataFrame, file_path: str, rowid: int, radius: int = 2) -> DataFrame:
    """The chunks beside one in its file, in order of insertion."""
    from pyspark.sql import Window

    own = chunks.where(F.col("file_path") == file_path).withColumn("place", F.row_number().over(Window.partitionBy("file_path").orderBy("rowid")))
    at = own.where(F.col("rowid") == rowid).select(F.col("place").alias("at"))
    return own.crossJoin(F.broadcast(at)).where((F.abs(F.col("place") - F.col("at")) <= radius) & (F.col("place") != F.col("at"))).drop("at")
