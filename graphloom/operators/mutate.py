"""Changes of a graph as functions from DataFrames to DataFrames; a store writes what they return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import traverse


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by (label, uid): what a new row has replaces, what it lacks stays.

    New rows are dealt out by their key before they are sorted for it, not as they lie in files. Of new rows of one key, each property is the last given by `_seq`; where there is no such
    column they have no order, and the greatest value counts.
    """
    keys = ["label", "uid"]
    new = new.repartition(*keys)
    if "_seq" in new.columns:
        new = new.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in new.columns if c not in (*keys, "_seq")))
    else:
        new = new.groupBy(*keys).agg(*(F.max(c).alias(c) for c in new.columns if c not in keys))
    a, b = nodes.alias("a"), new.alias("b")
    there = set(new.columns)
    values = [F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c) if c in there else F.col(f"a.{c}").alias(c) for c in nodes.columns]
    return a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full_outer").select(*values)


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges both of whose ends are nodes."""
    for end in ("src_uid", "dst_uid"):
        edges = edges.join(traverse.apart(nodes.select(F.col("uid").alias(end))), end, "left_semi")
    return edges


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add edges whose ends both exist; an edge of equal ends, type and line is there once. Old edges are distinct already and only met by the new ones."""
    sound = with_ends(new, nodes)
    keys = ["src_uid", "dst_uid", "type", "line"]
    fresh = sound.select(*edges.columns).dropDuplicates(keys).alias("n")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return edges.unionByName(fresh.join(traverse.apart(edges.select(*keys)).alias("o"), same, "left_anti").select(*edges.columns))


def delete_nodes(nodes: DataFrame, edges: DataFrame, which: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes that `which` holds for and the edges at them."""
    gone = nodes.where(which).select("uid").distinct()
    kept = edges
    for end in ("src_uid", "dst_uid"):
        kept = kept.join(gone.withColumnRenamed("uid", end), end, "left_anti")
    return nodes.where(~F.coalesce(which, F.lit(False))), kept.select(*edges.columns)


def of_files(files: DataFrame | list[str]) -> Column:
    """Nodes of given files, modules by their path too."""
    return F.col("file").isin(files) | F.col("path").isin(files)


def delete_files(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the nodes of the files listed in column `file`."""
    keys = files.select(F.col("file").alias("_file")).distinct()
    marked = nodes.join(keys, F.coalesce("file", "path") == F.col("_file"), "left")
    gone = marked.where("_file is not null").select("uid").distinct()
    kept = edges
    for end in ("src_uid", "dst_uid"):
        kept = kept.join(gone.withColumnRenamed("uid", end), end, "left_anti")
    return marked.where("_file is null").select(*nodes.columns), kept.select(*edges.columns)


def in_folders(folders: tuple[str, ...]) -> Column:
    """Nodes of files below one of the folders, at the start of a path too."""
    path = F.concat(F.lit("/"), F.coalesce("file", "path"))
    out = F.lit(False)
    for folder in folders:
        out = out | path.contains(f"/{folder}/")
    return out


def set_fqn(nodes: DataFrame, uid: str, fqn: str) -> DataFrame:
    return nodes.withColumn("fqn", F.when(F.col("uid") == uid, F.lit(fqn)).otherwise(F.col("fqn")))


def tag_file(nodes: DataFrame, file: str, repository: str) -> DataFrame:
    return nodes.withColumn("repository", F.when(F.col("file") == file, F.lit(repository)).otherwise(F.col("repository")))


def tag_unowned(nodes: DataFrame, repository: str, folder: str | None = None) -> DataFrame:
    """Nodes of no repository whose file is below `folder`, or without one is relative, get the repository; nodes without a file do not."""
    place = F.col("file").startswith(folder) if folder else ~F.col("file").startswith("/")
    return nodes.withColumn("repository", F.when(F.col("repository").isNull() & place, F.lit(repository)).otherwise(F.col("repository")))


def strip_prefix(nodes: DataFrame, edges: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
    """Paths that begin with `prefix` become relative, uids and edges with them."""
    cut = lambda x: F.when(x.startswith(prefix), F.substring(x, F.lit(len(prefix) + 1), F.length(x))).otherwise(x)
    # a uid is a label, a colon and the path: the prefix goes there only, not where a name holds it again
    own = lambda x: F.expr(f"instr({x}, ':')")
    path = lambda x: F.substring(F.col(x), own(x) + 1, F.length(x))
    inner = lambda x: F.when((own(x) > 0) & path(x).startswith(prefix), F.concat(F.substring(F.col(x), F.lit(1), own(x)), cut(path(x)))).otherwise(F.col(x))
    moved = nodes.withColumn("uid", inner("uid"))
    moved = moved.withColumn("file", cut(F.col("file"))).withColumn("path", cut(F.col("path")))
    return moved, edges.withColumn("src_uid", inner("src_uid")).withColumn("dst_uid", inner("dst_uid"))
