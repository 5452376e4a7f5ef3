"""Analysis of a whole repository: import targets, related chunks, the knowledge graph and summaries of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexarray.operators import graph, quality

FILE, FUNCTION, CLASS = "file", "function", "class"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def import_target(statement: Column, language: Column) -> Column:
    """The module an import line names: for Python its first component, for JavaScript the file without its ending."""
    plain = F.split(F.split(F.replace(statement, F.lit("import "), F.lit("")), " as ")[0], r"\.")[0]
    after = F.get(F.split(statement, "from "), 1)
    python = F.when(statement.startswith("import "), plain).when(statement.startswith("from "), F.split(F.split(after, " import")[0], r"\.")[0])
    last = F.element_at(F.split(F.regexp_replace(F.trim(after), r"^['\"]+|['\"]+$", ""), "/"), -1)
    script = F.when(statement.contains("from "), F.replace(F.replace(last, F.lit(".js"), F.lit("")), F.lit(".ts"), F.lit("")))
    return F.when(language == "python", python).when(language.isin("javascript", "typescript"), script)


def dependencies(imports: Column, language: Column) -> Column:
    """Distinct modules that import lines name; null if there are none."""
    after = lambda s: F.get(F.split(s, "from "), 1)
    bare = lambda s: F.regexp_replace(F.trim(s), "['\"]", "")
    python = lambda s: F.when(s.startswith("import "), F.split(F.split(F.replace(s, F.lit("import "), F.lit("")), r"\.")[0], " as ")[0]).when(s.startswith("from "), F.split(F.split(after(s), " import")[0], r"\.")[0])
    required = lambda s: F.nullif(F.regexp_extract(s, r"require\(([^)]+)\)", 1), F.lit(""))
    script = lambda s: F.when(s.contains("from "), F.regexp_replace(bare(after(s)), ";+$", "")).when(s.contains("require("), F.regexp_replace(required(s), "['\"]", ""))
    found = F.when(language == "python", F.transform(imports, python)).when(language.isin("javascript", "typescript"), F.transform(imports, script))
    found = F.array_distinct(F.array_compact(found))
    return F.when(F.size(found) > 0, found)


def _grams(name: Column) -> Column:
    """All pieces of a name of one to three characters."""
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substring(name, i, F.lit(n)))
    return F.array_distinct(F.concat(pieces(1), pieces(2), pieces(3)))


def first_files(modules: DataFrame, files: DataFrame) -> DataFrame:
    """(module, file_path): for each module the first file by ordinal whose name contains it.

    modules: module; files: file_path, ordinal. Names are found by the module's first three characters, so that
    only files with these are compared, and no module meets all files.
    """
    keyed = files.select("file_path", "ordinal", base_name(F.col("file_path")).alias("name")).withColumn("gram", F.explode(_grams(F.col("name"))))
    asked = modules.where("module <> ''").select("module").distinct().withColumn("gram", F.substring("module", 1, 3))
    found = asked.join(keyed, "gram").where(F.col("name").contains(F.col("module")))
    return found.groupBy("module").agg(F.min_by("file_path", "ordinal").alias("file_path"))


def _files(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_path").agg(F.min("rowid").alias("ordinal"))


def imported_files(chunks: DataFrame) -> DataFrame:
    """(rowid, place, module, file_path): the file that each import line of each chunk means, where one exists."""
    lines = chunks.select("rowid", "language", F.posexplode("import_statements").alias("place", "statement"))
    lines = lines.select("rowid", "place", import_target(F.col("statement"), F.col("language")).alias("module")).where("module is not null")
    return lines.join(first_files(lines, _files(chunks)), "module")


def module_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of files, functions and classes with contains, inherits and imports edges, one a chunk and line."""
    nodes, edges = graph.module_graph(chunks)
    own = chunks.select("rowid", F.concat(F.lit("file:"), "file_path").alias("source"))
    imports = imported_files(chunks).join(own, "rowid").select("source", F.concat(F.lit("file:"), "file_path").alias("target"), F.lit("imports").alias("relationship"))
    return nodes, edges.unionByName(imports)


def file_distance(nodes: DataFrame, edges: DataFrame, a: str, b: str) -> int:
    """Steps from file a to file b along the edges, -1 without a path."""
    return len(graph.shortest_path(nodes, edges, f"file:{a}", f"file:{b}")) - 1


def distances_to(edges: DataFrame, goal: str) -> DataFrame:
    """(id, distance): the steps of a shortest directed path from each node to goal; nodes without one are left out."""
    hops = edges.select("source", "target").distinct()
    found = edge = edges.sparkSession.createDataFrame([(goal, 0)], "id string, distance int")
    step = 0
    while not edge.isEmpty():
        step += 1
        edge = graph.cut(hops.join(edge.select(F.col("id").alias("target")), "target").select(F.col("source").alias("id")).distinct().join(found, "id", "left_anti").withColumn("distance", F.lit(step)))
        found = found.unionByName(edge)
    return found


def related(chunks: DataFrame, most: int = 10, asked: DataFrame | None = None) -> DataFrame:
    """(rowid, place, related, source): up to `most` chunks that each chunk refers to.

    Imports come first (three chunks of the file a line means), then bases (two chunks of the first class so named),
    then calls (the first function of each name, names in order); a chunk is listed once, itself never. asked: the
    rows of chunks to answer for, by default all.
    """
    asked = chunks if asked is None else asked
    nth = F.row_number().over(Window.partitionBy("file_path").orderBy("rowid"))
    first = chunks.select("file_path", F.col("rowid").alias("related"), nth.alias("nth")).where("nth <= 3")
    imports = imported_files(chunks).join(asked.select("rowid"), "rowid", "left_semi").join(first, "file_path")
    imports = imports.select("rowid", "related", F.struct(F.lit(0).alias("leg"), F.col("place").alias("a"), F.lit("").alias("b"), F.col("nth").alias("c")).alias("order"))

    classes = chunks.where("class_name is not null").select("file_path", F.col("class_name").alias("name"), F.col("rowid").alias("related"))
    home = classes.groupBy("name").agg(F.min_by("file_path", "related").alias("file_path"))
    nth = F.row_number().over(Window.partitionBy("name", "file_path").orderBy("related"))
    classes = classes.join(home, ["name", "file_path"]).withColumn("nth", nth).where("nth <= 2")
    bases = asked.where("class_name is not null").select("rowid", F.posexplode("inheritance_chain").alias("place", "name")).join(classes, "name")
    bases = bases.select("rowid", "related", F.struct(F.lit(1).alias("leg"), F.col("place").alias("a"), F.lit("").alias("b"), F.col("nth").alias("c")).alias("order"))

    functions = chunks.where("function_name is not null and semantic_type like '%function%'").groupBy(F.col("function_name").alias("name")).agg(F.min("rowid").alias("related"))
    called = asked.select("rowid", F.explode(graph.calls(F.col("content"))).alias("name")).join(functions, "name")
    called = called.select("rowid", "related", F.struct(F.lit(2).alias("leg"), F.lit(0).alias("a"), F.col("name").alias("b"), F.lit(0).alias("c")).alias("order"))

    once = imports.unionByName(bases).unionByName(called).where("rowid <> related").groupBy("rowid", "related").agg(F.min("order").alias("order"))
    out = once.withColumn("place", F.row_number().over(Window.partitionBy("rowid").orderBy("order"))).where(F.col("place") <= most)
    names = F.array(*[F.lit(x) for x in ("import", "inheritance", "call")])
    return out.select("rowid", "place", "related", F.element_at(names, F.col("order.leg") + 1).alias("source"))


def context_chunks(chunks: DataFrame, file_path: str, rowid: int, radius: int = 2, most: int = 5) -> DataFrame:
    """(part, place, rowid): the chunks beside one in its file, then up to `most` related ones."""
    beside = graph.context_window(chunks, file_path, rowid, radius).select(F.lit("beside").alias("part"), "place", "rowid")
    more = related(chunks, most, chunks.where(F.col("rowid") == rowid))
    return beside.unionByName(more.select(F.lit("related").alias("part"), "place", F.col("related").alias("rowid")))


def reranked(chunks: DataFrame, query: str, nodes: DataFrame, edges: DataFrame, current_file: str | None = None) -> DataFrame:
    """chunks with context_score, best first: nearness to the current file in the graph, imports, calls and clusters."""
    rows = chunks.withColumn("distance", F.lit(None).cast("int"))
    if current_file is not None:
        near = distances_to(edges, f"file:{current_file}").join(nodes.where("type = 'file'").select("id"), "id", "left_semi")
        near = near.select(F.expr("substring(id, 6)").alias("file_path"), "distance")
        rows = chunks.join(near, "file_path", "left")
    score = quality.context_score(F.lit(query), F.col("content"), F.col("import_statements"), F.col("file_path"), F.col("distance"))
    return rows.withColumn("context_score", score).orderBy(F.desc("context_score"), "rowid")


def knowledge_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): entities named without their file, so that equal names are one; the last chunk describes a
    function or class, the first a file; each edge once."""
    file_id = F.concat(F.lit("file:"), "file_path")
    nodes = chunks.select(file_id.alias("id"), F.lit(FILE).alias("type"), base_name(F.col("file_path")).alias("name"), "file_path").distinct()
    edges = []
    for kind in (FUNCTION, CLASS):
        own = chunks.where(F.col(f"{kind}_name").isNotNull()).select("rowid", "file_path", F.col(f"{kind}_name").alias("name"))
        key = F.concat(F.lit(f"{kind}:"), "name")
        nodes = nodes.unionByName(own.groupBy("name").agg(F.max_by("file_path", "rowid").alias("file_path")).select(key.alias("id"), F.lit(kind).alias("type"), "name", "file_path"))
        edges.append(own.select(file_id.alias("source"), key.alias("target"), F.lit("contains").alias("relationship")))
    return nodes, edges[0].unionByName(edges[1]).distinct()


def entities(nodes: DataFrame, kind: str, pattern: str | None = None) -> DataFrame:
    """Nodes of a kind whose name holds the pattern in any case."""
    rows = nodes.where(F.col("type") == kind)
    return rows if pattern is None else rows.where(F.lower("name").contains(pattern.lower()))


def relationships(edges: DataFrame, entity: str, kind: str | None = None) -> DataFrame:
    rows = edges.where((F.col("source") == entity) | (F.col("target") == entity))
    return rows if kind is None else rows.where(F.col("relationship") == kind)


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n): how many nodes of each type and edges of each relationship there are."""
    by = lambda df, part, c: df.groupBy(F.col(c).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "kind", "n")
    return by(nodes, "node", "type").unionByName(by(edges, "edge", "relationship"))


def file_summaries(chunks: DataFrame) -> DataFrame:
    """What each file's chunks import, depend on and define, each once and in order."""
    united = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.coalesce(c, F.array().cast("array<string>"))))))
    named = lambda c: F.sort_array(F.collect_set(c))
    return chunks.groupBy("file_path").agg(united("import_statements").alias("imports"), united("dependencies").alias("dependencies"), named("function_name").alias("functions"), named("class_name").alias("classes"))


def file_metadata(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Imports, dependencies and counts of each file (path, language, content), from its text and its chunks."""
    kinds = F.col("semantic_type")
    counts = chunks.groupBy("file_path").agg(F.count_if(kinds.isin("function_definition", "async_function_definition", "method_definition")).alias("total_functions"), F.count_if(kinds.isin("class_definition", "class_declaration")).alias("total_classes"))
    lines = None
    for language in ("python", "java", "rust", "go", "javascript", "typescript"):
        found = graph.import_lines(F.col("content"), language)
        lines = F.when(F.col("language") == language, found) if lines is None else lines.when(F.col("language") == language, found)
    rows = files.select(F.col("path").alias("file_path"), "language", lines.alias("imports"), F.size(F.split("content", "\n")).alias("total_lines"))
    rows = rows.withColumn("dependencies", dependencies(F.col("imports"), F.col("language")))
    return rows.join(counts, "file_path", "left").fillna(0, ["total_functions", "total_classes"])


def by_function_name(chunks: DataFrame, name: str, most: int = 5) -> DataFrame:
    return chunks.where((F.col("function_name") == name) & F.col("semantic_type").contains("function")).orderBy("rowid").limit(most)


def of_file(chunks: DataFrame, path: str) -> DataFrame:
    return chunks.where(F.col("file_path") == path).orderBy("rowid")
