"""Edges that names make: within a file by its ranges, across files by exploded lists of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import traverse

RESOLVED = ("INHERITS", "IMPORTS", "REFERENCES")


def by_name(nodes: DataFrame, label: str, names: str, targets: tuple[str, ...], type_: str, key: Column | None = None, other: bool = True) -> DataFrame:
    """Edges from nodes of a label to all nodes of the target labels that bear one of the names listed in a column.

    Each name is looked up once for each node that lists it; a name that very many nodes bear
    or list is one join key, which Spark splits at run time. Edges may be far more than nodes, so
    they are not shuffled to be made distinct, but where a target has several rows of other names.
    """
    asked = nodes.where((F.col("label") == label) & (F.size(names) > 0)).select(F.col("uid").alias("src_uid"), F.explode(names).alias("raw"))
    asked = asked.select("src_uid", (F.col("raw") if key is None else key).alias("name")).distinct()
    there = nodes.where(F.col("label").isin(*targets) & F.col("name").isNotNull()).select(F.col("uid").alias("dst_uid"), "name").distinct()
    held = there.withColumn("_names", F.count(F.lit(1)).over(Window.partitionBy("dst_uid")))
    # who bears one name meets a node that asks for it once; only who bears several may meet it again
    pairs = asked.join(held, "name")
    pairs = pairs.where("src_uid <> dst_uid") if other else pairs
    columns = "src_uid", "dst_uid", F.lit(type_).alias("type"), F.lit(None).cast("long").alias("line")
    return pairs.where("_names = 1").select(*columns).unionByName(pairs.where("_names > 1").select(*columns).distinct())


def inherits(nodes: DataFrame) -> DataFrame:
    return by_name(nodes, "Class", "base_classes", ("Class",), "INHERITS")


def imports(nodes: DataFrame) -> DataFrame:
    """By what follows the last dot of an import."""
    return by_name(nodes, "Module", "imports", ("Module",), "IMPORTS", F.substring_index("raw", ".", -1))


def references(nodes: DataFrame) -> DataFrame:
    return by_name(nodes, "Document", "code_references", ("Function", "Class"), "REFERENCES", other=False)


def within(edges: DataFrame) -> DataFrame:
    """The edges that are not across files."""
    return edges.where(~F.col("type").isin(*RESOLVED))


def resolve(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`edges` with those across files made anew."""
    kept = within(edges)
    return kept.unionByName(inherits(nodes)).unionByName(imports(nodes)).unionByName(references(nodes))


#: Names that nodes bear, with their label as kind, and names that they ask for, with the type of the edge.
NAMES = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "kind", "uid")])
#: Kinds of names under which a node's file, or a module's path, and a qualified name are kept.
FILE, FQN = "FILE", "FQN"
_LISTS = {"INHERITS": ("Class", "base_classes"), "IMPORTS": ("Module", "imports"), "REFERENCES": ("Document", "code_references")}
_TARGETS = {"INHERITS": ("Class",), "IMPORTS": ("Module",), "REFERENCES": ("Function", "Class")}
_BORNE = sorted({label for labels in _TARGETS.values() for label in labels})


#: Columns of nodes that names are taken from.
NAMED = ("uid", "label", "name", "file", "path", "fqn", "base_classes", "imports", "code_references")


def index(nodes: DataFrame) -> DataFrame:
    """NAMES of nodes, their files and qualified names, each once a node, in one pass over the nodes; an import asks for what follows its last dot."""
    label, kind = F.col("label"), "array<struct<name:string,kind:string>>"
    held = [(F.when(label.isin("Function", "Class", "Module"), F.col("name")), label), (F.coalesce("file", "path"), F.lit(FILE)), (F.col("fqn"), F.lit(FQN))]
    lists = [F.array(*(F.struct(name.alias("name"), k.alias("kind")) for name, k in held)).cast(kind)]
    for type_, (own, names) in _LISTS.items():
        last = type_ == "IMPORTS"
        asked = F.transform(names, lambda raw: F.struct((F.substring_index(raw, ".", -1) if last else raw).alias("name"), F.lit(type_).alias("kind")))  # noqa: B023
        lists.append(F.coalesce(F.when(label == own, asked).cast(kind), F.array().cast(kind)))
    return nodes.select("uid", F.inline(F.array_distinct(F.concat(*lists)))).where("name is not null").select("name", "kind", "uid")


GRAMS = T.StructType([T.StructField(c, T.StringType()) for c in ("gram", "name")])


def grams(nodes: DataFrame) -> DataFrame:
    """(gram, name): every three letters in a row, in lower case, of the distinct names of functions, classes and modules."""
    names = nodes.where(F.col("label").isin("Function", "Class", "Module") & F.col("name").isNotNull()).select("name").distinct()
    low = F.lower("name")
    return names.where(F.length(low) >= 3).select(F.explode(triples(low)).alias("gram"), "name")


def triples(text: Column) -> Column:
    """The distinct three letters in a row of texts of three letters at least."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def supported(asks: DataFrame, bears: DataFrame) -> DataFrame:
    """(src_uid, dst_uid, type, before, after) of edges for which a name asked for in `asks` is borne in `bears`, both before or both after."""
    fits = F.lit(False)
    for kind, labels in _TARGETS.items():
        other = F.lit(True) if kind == "REFERENCES" else F.col("src_uid") != F.col("dst_uid")
        fits = fits | ((F.col("type") == kind) & F.col("_label").isin(*labels) & other)
    a = asks.where(F.col("kind").isin(*_TARGETS)).select("name", F.col("uid").alias("src_uid"), F.col("kind").alias("type"), "before", "after")
    b = bears.where(F.col("kind").isin(*_BORNE)).select("name", F.col("uid").alias("dst_uid"), F.col("kind").alias("_label"), F.col("before").alias("_before"), F.col("after").alias("_after"))
    both = [(F.col(c) * F.col(f"_{c}")).alias(c) for c in ("before", "after")]
    return a.join(traverse.apart(b), "name").where(fits).select("src_uid", "dst_uid", "type", *both).where("before + after > 0")


def delta(old: DataFrame, new: DataFrame, touched: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges across files that a change adds, and those that it takes away.

    `old` and `new` are the changed nodes before and after, `touched` their uids, and `names` the
    NAMES before, of at least the names that old or new nodes bear or ask for. Each edge at a
    changed node is counted by the names that support it, before (-1) and after (+1): from changed
    nodes to all, and from unchanged ones to changed. One whose supports before are all gone goes.
    Old and new names are marked and joined together; names and counts are written once, and both sides and both answers read them.
    """
    mark = lambda rows, before, after: rows.where(F.col("kind").isin(*_TARGETS, *_BORNE)).withColumn("before", F.lit(before)).withColumn("after", F.lit(after))
    rest = traverse.cut(mark(names.join(traverse.sized(touched.select("uid")), "uid", "left_anti"), 1, 1))
    rows = traverse.cut(mark(index(old), 1, 0).unionByName(mark(index(new), 0, 1)))
    counted = supported(rows, rest.unionByName(rows)).unionByName(supported(rest, rows))
    counted = counted.groupBy("src_uid", "dst_uid", "type").agg(F.sum("before").alias("before"), F.sum("after").alias("after")).withColumn("line", F.lit(None).cast("long"))
    keys, counted = ["src_uid", "dst_uid", "type", "line"], traverse.cut(counted)
    return counted.where("after > 0").select(*keys), counted.where("before > 0 and after = 0").select(*keys)


def calls(functions: DataFrame, sites: DataFrame) -> DataFrame:
    """CALLS edges of call sites (file, caller, callee, line) to functions of the same file; of namesakes the last counts, calls of itself do not."""
    last = functions.groupBy("file", "name").agg(F.max_by("uid", F.struct("start_line", "uid")).alias("uid"))
    caller = last.select("file", F.col("name").alias("caller"), F.col("uid").alias("src_uid"))
    callee = last.select("file", F.col("name").alias("callee"), F.col("uid").alias("dst_uid"))
    found = sites.join(caller, ["file", "caller"]).join(callee, ["file", "callee"]).where("caller <> callee")
    return found.select("src_uid", "dst_uid", F.lit("CALLS").alias("type"), F.col("line").cast("long").alias("line")).distinct()
