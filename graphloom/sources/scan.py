"""Files, documents and payloads to nodes and edges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import resolve, traverse
from ..schema import as_edges, as_nodes, uid
from . import parse


def files(spark: SparkSession, folder: str, documents: bool = False) -> DataFrame:
    """(path, content) of the source files, or documents, below a folder; paths are relative, excluded folders left out.

    Spark lists and splits the files, and a file that is not UTF-8 keeps what can be decoded.
    """
    kinds = X.DOC_SUFFIXES if documents else tuple(X.LANGUAGES)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*{%s}" % ",".join(kinds)).load(folder)
    root = folder.rstrip("/").split(":", 1)[-1]
    return found.select(_below(root).alias("path"), F.decode("content", "UTF-8").alias("content")).where(~X.excluded("path"))


def _below(root: str) -> Column:
    """The part of `path` below a folder."""
    return F.substring_index(F.regexp_replace("path", r"^[a-z]+:/*", "/"), root.rstrip("/") + "/", -1)


def named_files(spark: SparkSession, folder: str, paths: list[str]) -> DataFrame:
    """(path, content) of the files of given relative paths below a folder; those that are not there have no row.

    The list is as long as a change feed's, which the driver has read from git anyway; contents are read by tasks.
    """
    root, context = folder.rstrip("/"), spark.sparkContext
    there = []
    for path in paths:
        full = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{path}")
        if full.getFileSystem(context._jsc.hadoopConfiguration()).exists(full):
            # what a glob reads as a pattern stands for itself
            there.append(re.sub(r"([\\*?\[\]{}^])", r"\\\1", f"{root}/{path}"))
    if not there:
        return payload(spark, [])
    found = spark.read.format("binaryFile").load(there)
    return found.select(_below(root.split(":", 1)[-1]).alias("path"), F.decode("content", "UTF-8").alias("content"))


def payload(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "path string, content string")


def entities(sources: DataFrame) -> DataFrame:
    """Parsed rows (path, language, and parse.SCHEMA) of source files, each read alone; `broken` is the line of a file's first error.

    Files are dealt out by path before they are parsed, as a table of millions of them may lie in one split.
    """
    known = sources.select("path", X.language("path").alias("language"), "content").where("language is not null and content is not null")
    return traverse.spread(known, "path").mapInArrow(parse.batches, parse.ENTITIES)


def register(spark: SparkSession) -> None:
    """Make the table function `parse_source(language, content)` known to SQL."""
    spark.udtf.register("parse_source", parse.ParseSource)


def code_graph(sources: DataFrame, module_identity: str = "path") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges within the files of (path, content).

    Modules hold classes and free functions, classes their methods; calls link functions of one
    file. A module's identity is its path, or with "stem" its name, where files of one stem become
    one node, the last path giving its properties.
    """
    found = traverse.cut(entities(sources))  # five joins read it, and each file is parsed once
    known = sources.select("path", X.language("path").alias("language")).where("language is not null")
    listed = found.where("kind = 'import'").groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("imports"))
    file = F.col("path") if module_identity == "path" else F.lit("")
    module = known.join(listed, "path", "left").select(F.lit("Module").alias("label"), X.stem("path").alias("name"), "path", "language", "imports", uid(F.lit("Module"), file, X.stem("path"), F.lit(0)).alias("uid"))
    if module_identity != "path":
        module = module.groupBy("label", "name", "uid").agg(*(F.max_by(c, "path").alias(c) for c in ("path", "language", "imports")))
    rows = found.where("kind in ('class', 'function')").withColumn("label", F.initcap("kind")).withColumn("uid", uid("label", "path", "name", "start_line"))
    is_function = F.col("label") == "Function"
    code = rows.select(
        "uid", "label", "name", F.col("path").alias("file"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "docstring", "language",
        F.when(is_function, F.col("signature")).alias("signature"), F.when(is_function, F.col("snippet")).alias("code_snippet"), F.when(~is_function, F.col("bases")).alias("base_classes"),
        F.nullif(X.java_fqn("path", "name", is_function, "owner"), F.lit("")).alias("fqn"),
    )
    nodes = traverse.spread(as_nodes(module).unionByName(as_nodes(code)), "uid").dropDuplicates(["label", "uid"])  # dealt out as embed.embed deals them out, so once
    module_uid = uid(F.lit("Module"), file, X.stem("path"), F.lit(0))
    owners = rows.where("label = 'Class'").groupBy("path", F.col("name").alias("owner")).agg(F.min_by("uid", "pos").alias("owner_uid"))
    contained = rows.join(owners, ["path", "owner"], "left").select(F.when(is_function, F.coalesce("owner_uid", module_uid)).otherwise(module_uid).alias("src_uid"), F.col("uid").alias("dst_uid"), F.lit("CONTAINS").alias("type"))
    functions = rows.where("label = 'Function'").select(F.col("path").alias("file"), "name", "uid", "start_line")
    sites = found.where("kind = 'call'").select(F.col("path").alias("file"), F.col("owner").alias("caller"), F.col("name").alias("callee"), F.col("start_line").alias("line"))
    return nodes, as_edges(contained.distinct()).unionByName(as_edges(resolve.calls(functions, sites)))


def document_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents (path, content): a root each, and a node for each section, its content cut to 2,000 characters.

    A root is named by its first section if that is of level 1, else by its file. A first section
    on line 1 of the root's name shares the root's uid, and they become one node that holds itself.
    """
    markdown = X.sections(docs.where(~F.lower("path").endswith(".rst")), "markdown")
    rst = X.sections(docs.where(F.lower("path").endswith(".rst")), "rst")
    parts = markdown.unionByName(rst)
    first = parts.where("pos = 1 and level = 1").select("path", F.col("title").alias("head"))
    roots = docs.join(first, "path", "left").select("path", F.coalesce("head", X.stem("path")).alias("name"), X.content_hash(F.coalesce("content", F.lit(""))).alias("content_hash"), X.code_references("content").alias("code_references"))
    root_uid = uid(F.lit("Document"), F.col("path"), F.col("name"), F.lit(1))
    root = roots.select(root_uid.alias("uid"), F.lit("Document").alias("label"), "name", F.col("path").alias("file"), F.lit(1).alias("start_line"), F.col("name").alias("title"), "content_hash", "code_references")
    joined = parts.join(roots.select("path", F.col("name").alias("doc"), root_uid.alias("root"), "content_hash"), "path")
    section = joined.select(uid(F.lit("Document"), F.col("path"), F.col("title"), F.col("start_line")).alias("uid"), F.lit("Document").alias("label"), F.col("title").alias("name"), F.col("path").alias("file"), "start_line", "content_hash", F.concat_ws(" > ", "doc", "title").alias("title"), F.col("title").alias("section"), F.left("body", F.lit(2000)).alias("content"), "level", "root")
    rows = as_nodes(root).withColumn("_s", F.lit(0)).unionByName(as_nodes(section).withColumn("_s", F.lit(1)))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_s"))).alias(c) for c in rows.columns if c not in ("uid", "label", "_s")]
    nodes = as_nodes(rows.groupBy("uid", "label").agg(*last))
    edges = as_edges(section.select(F.col("root").alias("src_uid"), F.col("uid").alias("dst_uid"), F.lit("CONTAINS").alias("type")).distinct())
    return nodes, edges
