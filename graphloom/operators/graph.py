"""Structured questions to a graph: each is a few joins, filters and groups over `nodes` and `edges`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import EDGE_TYPES, LABELS
from . import traverse

CODE = ("Function", "Class", "Module")


def empty(x: str) -> Column:
    return F.coalesce(F.col(x), F.lit(""))


def named(nodes: DataFrame, name: str, *labels: str) -> DataFrame:
    """Nodes whose qualified name or name is `name`, trimmed."""
    rows = nodes.where(F.col("label").isin(*labels)) if labels else nodes
    return rows.where((F.col("fqn") == name.strip()) | (F.col("name") == name.strip()))


def of_type(edges: DataFrame, *types: str) -> DataFrame:
    return edges.where(F.col("type").isin(*types))


def expand(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, type_: str, direction: str = "out") -> DataFrame:
    """Nodes one edge away from `seeds`, as many rows as edges; the seed's uid is `seed`."""
    near, far = ("src_uid", "dst_uid") if direction == "out" else ("dst_uid", "src_uid")
    hop = of_type(edges, type_).select(F.col(near).alias("seed"), F.col(far).alias("uid"))
    return hop.join(traverse.sized(seeds.select(F.col("uid").alias("seed"))), "seed").join(nodes, "uid")


# --- traversals -----------------------------------------------------------------------------


def call_chain(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 3, direction: str = "downstream") -> DataFrame:
    """Distinct calls on paths of 1 to `depth` from (downstream) or to (upstream) functions of a name: both ends' name, file and line."""
    functions = nodes.where("label = 'Function'")
    calls = of_type(edges, "CALLS")
    found = traverse.path_edges(named(functions, name), calls, depth, "out" if direction == "downstream" else "in").select("src_uid", "dst_uid").distinct()
    ends = {k: functions.select(F.col("uid").alias(f"{k}_uid"), F.col("name").alias(f"{a}_name"), empty("file").alias(f"{a}_file"), F.col("start_line").alias(f"{a}_line")) for k, a in (("src", "source"), ("dst", "target"))}
    return found.join(ends["src"], "src_uid").join(ends["dst"], "dst_uid").drop("src_uid", "dst_uid").distinct()


def call_chain_nodes(chain: DataFrame) -> DataFrame:
    """The nodes of a call chain, one for each name and line; of several files the first counts."""
    ends = [chain.select(F.col(f"{a}_name").alias("name"), F.col(f"{a}_file").alias("file"), F.col(f"{a}_line").alias("start_line")) for a in ("source", "target")]
    return ends[0].union(ends[1]).groupBy("name", "start_line").agg(F.min("file").alias("file"))


def inheritance_tree(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "children", distinct: bool = False, depth: int = 10) -> DataFrame:
    """Parents or (any other direction) children of classes of a name over up to ten edges: one row for each trail, or with `distinct` each class."""
    classes = nodes.where("label = 'Class'")
    found = traverse.trail_counts(named(classes, name).select("uid"), of_type(edges, "INHERITS"), depth, "out" if direction == "parents" else "in", distinct)
    return traverse.multiplied(found.join(classes, "uid").select("name", empty("file").alias("file"), "start_line", "length", "n"))


def class_methods(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    found = expand(named(nodes, name, "Class"), edges, nodes.where("label = 'Function'"), "CONTAINS")
    return found.select("name", empty("signature").alias("signature"), empty("file").alias("file"), "start_line").orderBy(F.asc_nulls_last("start_line"), "name")


def module_dependencies(nodes: DataFrame, edges: DataFrame, name: str, reverse: bool = False) -> DataFrame:
    """Modules that a module imports, or with `reverse` those that import it."""
    found = expand(named(nodes, name, "Module"), edges, nodes.where("label = 'Module'"), "IMPORTS", "in" if reverse else "out")
    return found.select("name", empty("path").alias("path"))


def find_entity(nodes: DataFrame, name: str, kind: str = "any") -> DataFrame:
    labels = {"function": ("Function",), "class": ("Class",)}.get(kind, CODE)
    signature = F.lit("") if kind == "class" else empty("signature")
    return named(nodes, name, *labels).select(F.col("label").alias("type"), "name", empty("file").alias("file"), "start_line", signature.alias("signature"))


def file_entities(nodes: DataFrame, file: str) -> DataFrame:
    rows = nodes.where(F.col("label").isin("Function", "Class") & (F.col("file") == file))
    return rows.select(F.col("label").alias("type"), "name", "start_line", empty("signature").alias("signature")).orderBy(F.asc_nulls_last("start_line"), "name")


def explore(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 2, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes within `depth` edges of nodes of a name, themselves included, and the distinct edges among them; `center` marks the first of the name."""
    seeds = named(nodes, name, *CODE).select("uid")
    near = traverse.ball(seeds, edges, depth).select("uid").distinct()
    found = nodes.join(near, "uid", "left_semi").where(F.col("label").isin(*LABELS))
    first = F.row_number().over(Window.partitionBy(F.col("name") == name.strip()).orderBy("uid"))
    shown = traverse.cut(found.orderBy(F.desc(F.coalesce(F.col("name") == name.strip(), F.lit(False))), "uid").limit(limit))
    shown = shown.withColumn("center", F.coalesce((F.col("name") == name.strip()) & (first == 1), F.lit(False)))
    return shown, induced(shown, edges)


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct (source, type, target) of edges with both ends among `nodes`."""
    ids = nodes.select("uid").distinct()
    inside = edges.join(ids.withColumnRenamed("uid", "src_uid"), "src_uid", "left_semi").join(ids.withColumnRenamed("uid", "dst_uid"), "dst_uid", "left_semi")
    return inside.select("src_uid", "type", "dst_uid").distinct()


def overview(nodes: DataFrame, limit: int = 100, seed: int = 0) -> DataFrame:
    """A random sample of code nodes, the same for the same seed and layout."""
    return nodes.where(F.col("label").isin(*CODE)).orderBy(F.rand(seed)).limit(limit)


def parent_class(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uid, parent): of each function that a class contains the least class name."""
    classes = nodes.where("label = 'Class'").select(F.col("uid").alias("src_uid"), F.col("name").alias("parent"))
    functions = nodes.where("label = 'Function'").select("uid")
    pairs = of_type(edges, "CONTAINS").join(classes, "src_uid").select(F.col("dst_uid").alias("uid"), "parent")
    return pairs.join(functions, "uid", "left_semi").groupBy("uid").agg(F.min("parent").alias("parent"))


def backfill_fqn(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` where Java functions and classes without a qualified name have the one their path gives."""
    rows = nodes.join(parent_class(nodes, edges), "uid", "left")
    made = F.nullif(X.java_fqn("file", "name", F.col("label") == "Function", "parent"), F.lit(""))
    lack = F.col("label").isin("Function", "Class") & F.coalesce(F.col("fqn"), F.lit("")).eqNullSafe("") & F.col("file").endswith(".java")
    return rows.withColumn("fqn", F.when(lack, made).otherwise(F.col("fqn"))).select(*nodes.columns)


# --- documents ------------------------------------------------------------------------------


def document_sections(nodes: DataFrame, edges: DataFrame, repository: str | None = None) -> DataFrame:
    """(doc_uid, doc_title, doc_file, repository, uid, title, level, start_line): sections of documents; documents without any are absent."""
    docs = nodes.where("label = 'Document'")
    roots = docs.where(F.col("repository") == repository) if repository else docs
    roots = roots.select(F.col("uid").alias("src_uid"), F.col("title").alias("doc_title"), F.col("file").alias("doc_file"), "repository")
    parts = docs.select(F.col("uid").alias("dst_uid"), "title", "level", "start_line")
    found = of_type(edges, "CONTAINS").select("src_uid", "dst_uid").join(roots, "src_uid").join(parts, "dst_uid")
    return found.select(F.col("src_uid").alias("doc_uid"), "doc_title", "doc_file", "repository", F.col("dst_uid").alias("uid"), "title", "level", "start_line")


def list_documents(nodes: DataFrame, edges: DataFrame, repository: str | None = None) -> DataFrame:
    """One row per document with its sections in order, sections without a line last."""
    section = F.struct(F.col("start_line").isNull().alias("late"), "start_line", "title", "uid", "level")
    grouped = document_sections(nodes, edges, repository).groupBy("doc_uid", "doc_title", "doc_file", "repository").agg(F.array_sort(F.collect_list(section)).alias("sections"))
    return grouped.orderBy(F.coalesce("repository", F.lit("")), F.coalesce("doc_file", F.lit("")), "doc_uid")


def get_document(nodes: DataFrame, edges: DataFrame, uid: str) -> DataFrame:
    return document_sections(nodes, edges).where(F.col("doc_uid") == uid).orderBy(F.asc_nulls_last("start_line"), "uid")


def document(nodes: DataFrame, edges: DataFrame, uid: str, files: DataFrame | None = None) -> DataFrame:
    """(uid, title, content, start_line, level) of a document's sections in order, with whole contents; levels are inferred where none are stored, from `files` (path, content) if given."""
    parts = get_document(nodes, edges, uid).select("doc_file", "uid", "start_line")
    own = nodes.select("uid", F.coalesce(F.nullif("name", F.lit("")), "title", F.lit("")).alias("title"), empty("content").alias("content"), "level")
    rows = parts.join(own, "uid").withColumn("path", F.coalesce("doc_file", F.lit(""))).drop("doc_file")
    found = X.outline_levels(rows, files).select("uid", "title", "content", "start_line", F.col("inferred_level").alias("level"))
    return found.orderBy(F.asc_nulls_last("start_line"), "uid")


def code_snippet(nodes: DataFrame, uid: str) -> DataFrame:
    texts = [empty(x).alias(x) for x in ("name", "file", "signature", "docstring", "code_snippet", "language")]
    return nodes.where(F.col("uid") == uid).select("uid", "label", *texts, "start_line", "end_line")


# --- counts ---------------------------------------------------------------------------------


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): rows per label and per edge type, absent ones 0; the type without a producer is left out."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([("node", x) for x in LABELS] + [("edge", x) for x in EDGE_TYPES if x != "USES_TYPE"], "kind string, name string")
    counts = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).count().union(edges.groupBy(F.lit("edge").alias("kind"), F.col("type").alias("name")).count())
    return wanted.join(counts, ["kind", "name"], "left").select("kind", "name", F.coalesce("count", F.lit(0)).alias("n"))


def repository_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("repository is not null").groupBy("repository").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "repository")


def repository_samples(nodes: DataFrame, most: int = 3) -> DataFrame:
    """(repository, files): up to `most` least files of each repository.

    Files are made distinct and ranked, and a limit on the rank is taken in each task before rows
    are shuffled, so that a repository's files never meet in one array.
    """
    files = nodes.where("repository is not null and file is not null").select("repository", "file").distinct()
    ranked = files.withColumn("n", F.row_number().over(Window.partitionBy("repository").orderBy("file"))).where(F.col("n") <= most)
    return ranked.groupBy("repository").agg(F.array_sort(F.collect_list("file")).alias("files"))


def prefix_count(nodes: DataFrame, repository: str, prefix: str) -> DataFrame:
    return nodes.where((F.col("repository") == repository) & F.col("file").startswith(prefix)).agg(F.count(F.lit(1)).alias("n"))
