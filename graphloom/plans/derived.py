"""A graph derived from star-schema tables, and queries over it with the SQL that gives the same rows.

The tables hold no source code, so parts stand for functions, suppliers for classes, nations for
modules and documents for sections; arithmetic on keys gives the edges. `GRAPH` is the same graph
in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as X
from ..operators import embed, graph, intervals, mutate, resolve, search, traverse
from ..schema import as_edges, as_nodes, uid
from ..sources import changes, scan
from ..streaming.feed import last_of_each

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Schemas by path, so that a table's footers are read for its columns once.
_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    key = lambda label, c: F.concat(F.lit(f"{label}:"), F.col(c).cast("string"))
    part = table(spark, d, "part").select(
        key("Function", "p_partkey").alias("uid"), F.lit("Function").alias("label"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("start_line"),
        F.col("p_type").alias("signature"), F.concat(F.lit("repo"), F.col("p_size") % 5).alias("repository"), F.concat(F.lit("a.b."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("fqn"),
    )
    supplier = table(spark, d, "supplier").select(key("Class", "s_suppkey").alias("uid"), F.lit("Class").alias("label"), F.col("s_name").alias("name"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25).alias("file"), F.col("s_suppkey").alias("start_line"))
    nation = table(spark, d, "nation").select(key("Module", "n_nationkey").alias("uid"), F.lit("Module").alias("label"), F.col("n_name").alias("name"), F.concat(F.lit("src/"), "n_name", F.lit(".py")).alias("path"))
    docs = table(spark, d, "documents")
    sections = docs.select(key("Document", "doc_id").alias("uid"), F.lit("Document").alias("label"), F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("file"), F.col("doc_id").alias("start_line"), F.col("text").alias("content"), F.concat(F.lit("Section "), F.col("doc_id").cast("string")).alias("title"))
    roots = docs.select("source").distinct().select(key("Document", "source").alias("uid"), F.lit("Document").alias("label"), F.col("source").alias("name"), F.col("source").alias("file"), F.col("source").alias("title"))
    out = as_nodes(part)
    for x in (supplier, nation, sections, roots):
        out = out.unionByName(as_nodes(x))
    return out


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    part, supplier, nation = (table(spark, d, t) for t in ("part", "supplier", "nation"))
    n, s = part.count(), supplier.count()
    edge = lambda kind, a, b, line=F.lit(None): (F.lit(kind).alias("type"), F.concat(F.lit(a[0]), a[1].cast("string")).alias("src_uid"), F.concat(F.lit(b[0]), b[1].cast("string")).alias("dst_uid"), line.cast("long").alias("line"))
    p, k = F.col("p_partkey"), F.col("s_suppkey")
    calls = [part.select(*edge("CALLS", ("Function:", p), ("Function:", (p * a + b) % n), F.lit(i))).where("src_uid <> dst_uid") for i, a, b in ((1, 3, 1), (2, 5, 2))]
    parents = supplier.where("s_suppkey >= 2").select(*edge("INHERITS", ("Class:", k), ("Class:", F.expr("s_suppkey div 2")))).union(supplier.where("s_suppkey >= 3").select(*edge("INHERITS", ("Class:", k), ("Class:", F.expr("s_suppkey div 3"))))).distinct()
    methods = part.select(*edge("CONTAINS", ("Class:", p % s), ("Function:", p)))
    classes = supplier.select(*edge("CONTAINS", ("Module:", F.col("s_nationkey")), ("Class:", k)))
    sections = table(spark, d, "documents").select(*edge("CONTAINS", ("Document:", F.col("source")), ("Document:", F.col("doc_id"))))
    other = nation.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    imports = nation.join(other, "n_regionkey").where("n_nationkey < b").select(*edge("IMPORTS", ("Module:", F.col("n_nationkey")), ("Module:", F.col("b"))))
    out = as_edges(calls[0])
    for x in (calls[1], parents, methods, classes, sections, imports):
        out = out.unionByName(as_edges(x))
    return out


GRAPH = """
nodes AS (
  SELECT 'Function:' || p_partkey AS uid, 'Function' AS label, p_name AS name, p_brand AS file, NULL AS path, p_partkey AS start_line, p_type AS signature,
         'repo' || (p_size % 5) AS repository, 'a.b.' || replace(p_name, ' ', '_') AS fqn, NULL AS content, NULL AS title FROM part
  UNION ALL SELECT 'Class:' || s_suppkey, 'Class', s_name, 'Brand#' || (s_suppkey % 25), NULL, s_suppkey, NULL, NULL, NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'Module:' || n_nationkey, 'Module', n_name, NULL, 'src/' || n_name || '.py', NULL, NULL, NULL, NULL, NULL, NULL FROM nation
  UNION ALL SELECT 'Document:' || doc_id, 'Document', source || '-' || doc_id, source, NULL, doc_id, NULL, NULL, NULL, text, 'Section ' || doc_id FROM documents
  UNION ALL SELECT DISTINCT 'Document:' || source, 'Document', source, source, NULL, NULL::BIGINT, NULL, NULL, NULL, NULL, source FROM documents
), edges AS (
  SELECT 'Function:' || p_partkey AS src_uid, 'Function:' || ((p_partkey * 3 + 1) % (SELECT count(*) FROM part)) AS dst_uid, 'CALLS' AS type, 1 AS line FROM part WHERE p_partkey <> (p_partkey * 3 + 1) % (SELECT count(*) FROM part)
  UNION ALL SELECT 'Function:' || p_partkey, 'Function:' || ((p_partkey * 5 + 2) % (SELECT count(*) FROM part)), 'CALLS', 2 FROM part WHERE p_partkey <> (p_partkey * 5 + 2) % (SELECT count(*) FROM part)
  UNION ALL (SELECT 'Class:' || s_suppkey, 'Class:' || (s_suppkey // 2), 'INHERITS', NULL FROM supplier WHERE s_suppkey >= 2 UNION SELECT 'Class:' || s_suppkey, 'Class:' || (s_suppkey // 3), 'INHERITS', NULL FROM supplier WHERE s_suppkey >= 3)
  UNION ALL SELECT 'Class:' || (p_partkey % (SELECT count(*) FROM supplier)), 'Function:' || p_partkey, 'CONTAINS', NULL FROM part
  UNION ALL SELECT 'Module:' || s_nationkey, 'Class:' || s_suppkey, 'CONTAINS', NULL FROM supplier
  UNION ALL SELECT 'Document:' || source, 'Document:' || doc_id, 'CONTAINS', NULL FROM documents
  UNION ALL SELECT 'Module:' || a.n_nationkey, 'Module:' || b.n_nationkey, 'IMPORTS', NULL FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
)"""


def query(name: str, sql: str | None = None, graph_sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; `graph_sql` is SQL over the derived graph's nodes and edges, with further CTEs if it begins with a comma."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if graph_sql is not None:
            body = graph_sql if graph_sql.lstrip().startswith(",") else f" {graph_sql}"
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{GRAPH.strip()}{body}"
        elif sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _chain(near: str, far: str) -> str:
    return f"""
, walk AS (
  SELECT uid, 0 AS d FROM nodes WHERE label = 'Function' AND (name = 'small ring' OR fqn = 'small ring')
  UNION SELECT e.{far}, w.d + 1 FROM walk w JOIN edges e ON e.type = 'CALLS' AND e.{near} = w.uid WHERE w.d < 2
)
SELECT DISTINCT a.name AS source_name, a.file AS source_file, a.start_line AS source_line, b.name AS target_name, b.file AS target_file, b.start_line AS target_line
FROM walk w JOIN edges e ON e.type = 'CALLS' AND e.{near} = w.uid JOIN nodes a ON a.uid = e.src_uid JOIN nodes b ON b.uid = e.dst_uid"""


@query("call_chain_down", graph_sql=_chain("src_uid", "dst_uid"), recursive=True)
def _(spark, d):
    return graph.call_chain(nodes_of(spark, d), edges_of(spark, d), "small ring", 3)


@query("call_chain_up", graph_sql=_chain("dst_uid", "src_uid"), recursive=True)
def _(spark, d):
    return graph.call_chain(nodes_of(spark, d), edges_of(spark, d), "small ring", 3, "upstream")


@query("call_chain_nodes", graph_sql=_chain("src_uid", "dst_uid").replace("SELECT DISTINCT a.name", ", chain AS (SELECT DISTINCT a.name") + """)
SELECT name, start_line, min(file) AS file FROM (SELECT source_name AS name, source_file AS file, source_line AS start_line FROM chain UNION ALL SELECT target_name, target_file, target_line FROM chain) GROUP BY ALL""", recursive=True)  # fmt: skip
def _(spark, d):
    return graph.call_chain_nodes(graph.call_chain(nodes_of(spark, d), edges_of(spark, d), "small ring", 3))


def _trails(seed: str, near: str, far: str, union: str = "UNION ALL") -> str:
    return f"""
, walk AS (
  SELECT uid, 0 AS length FROM nodes WHERE label = 'Class' AND name = '{seed}'
  UNION ALL SELECT e.{far}, w.length + 1 FROM walk w JOIN edges e ON e.type = 'INHERITS' AND e.{near} = w.uid WHERE w.length < 10
)
SELECT n.name, n.file, n.start_line, w.length FROM walk w JOIN nodes n ON n.uid = w.uid AND n.label = 'Class' WHERE w.length > 0"""


@query("inheritance_parents", graph_sql=_trails("Supplier#000000009", "src_uid", "dst_uid"), recursive=True)
def _(spark, d):
    return graph.inheritance_tree(nodes_of(spark, d), edges_of(spark, d), "Supplier#000000009", "parents")


@query("inheritance_children", graph_sql=_trails("Supplier#000000001", "dst_uid", "src_uid"), recursive=True)
def _(spark, d):
    return graph.inheritance_tree(nodes_of(spark, d), edges_of(spark, d), "Supplier#000000001", "children")


@query("inheritance_distinct", graph_sql=_trails("Supplier#000000001", "dst_uid", "src_uid").replace("w.length FROM", "min(w.length) AS length FROM") + " GROUP BY n.uid, n.name, n.file, n.start_line", recursive=True)
def _(spark, d):
    return graph.inheritance_tree(nodes_of(spark, d), edges_of(spark, d), "Supplier#000000001", "children", distinct=True)


@query("class_methods", graph_sql="SELECT f.name, f.signature, f.file, f.start_line FROM nodes c JOIN edges e ON e.src_uid = c.uid AND e.type = 'CONTAINS' JOIN nodes f ON f.uid = e.dst_uid AND f.label = 'Function' WHERE c.label = 'Class' AND c.name = 'Supplier#000000003'")
def _(spark, d):
    return graph.class_methods(nodes_of(spark, d), edges_of(spark, d), "Supplier#000000003")


@query("module_dependencies", graph_sql="SELECT b.name, b.path FROM nodes a JOIN edges e ON e.src_uid = a.uid AND e.type = 'IMPORTS' JOIN nodes b ON b.uid = e.dst_uid WHERE a.name = 'NATION_1'")
def _(spark, d):
    return graph.module_dependencies(nodes_of(spark, d), edges_of(spark, d), "NATION_1")


@query("reverse_dependencies", graph_sql="SELECT a.name, a.path FROM nodes a JOIN edges e ON e.src_uid = a.uid AND e.type = 'IMPORTS' JOIN nodes b ON b.uid = e.dst_uid WHERE b.name = 'NATION_20'")
def _(spark, d):
    return graph.module_dependencies(nodes_of(spark, d), edges_of(spark, d), "NATION_20", reverse=True)


@query("find_entity", graph_sql="SELECT label AS type, name, coalesce(file, '') AS file, start_line, coalesce(signature, '') AS signature FROM nodes WHERE label IN ('Function', 'Class', 'Module') AND (name = 'red widget' OR fqn = 'red widget')")
def _(spark, d):
    return graph.find_entity(nodes_of(spark, d), " red widget ")


@query("find_entity_class", graph_sql="SELECT label AS type, name, coalesce(file, '') AS file, start_line, '' AS signature FROM nodes WHERE label = 'Class' AND name = 'Supplier#000000007'")
def _(spark, d):
    return graph.find_entity(nodes_of(spark, d), "Supplier#000000007", "class")


@query("file_entities", graph_sql="SELECT label AS type, name, start_line, coalesce(signature, '') AS signature FROM nodes WHERE label IN ('Function', 'Class') AND file = 'Brand#12'")
def _(spark, d):
    return graph.file_entities(nodes_of(spark, d), "Brand#12")


_BALL = """
, walk AS (
  SELECT uid, 0 AS d FROM nodes WHERE label = 'Class' AND name = 'Supplier#000000005'
  UNION SELECT CASE WHEN e.src_uid = w.uid THEN e.dst_uid ELSE e.src_uid END, w.d + 1 FROM walk w JOIN edges e ON e.src_uid = w.uid OR e.dst_uid = w.uid WHERE w.d < 2
), near AS (SELECT DISTINCT uid FROM walk)
"""


def _near(spark, d):
    n, e = nodes_of(spark, d), edges_of(spark, d)
    return n.join(traverse.ball(n.where("label = 'Class' and name = 'Supplier#000000005'").select("uid"), e, 2).select("uid").distinct(), "uid", "left_semi"), e


@query("explore_nodes", graph_sql=_BALL + "SELECT n.uid, n.label, n.name FROM nodes n JOIN near USING (uid)", recursive=True)
def _(spark, d):
    return _near(spark, d)[0].select("uid", "label", "name")


@query("explore_edges", graph_sql=_BALL + "SELECT DISTINCT e.src_uid, e.type, e.dst_uid FROM edges e WHERE e.src_uid IN (SELECT uid FROM near) AND e.dst_uid IN (SELECT uid FROM near)", recursive=True)
def _(spark, d):
    return graph.induced(*_near(spark, d))


@query("explore_center", graph_sql=_BALL + "SELECT n.uid, n.name = 'Supplier#000000005' AND n.uid = (SELECT min(uid) FROM nodes WHERE name = 'Supplier#000000005') AS center FROM nodes n JOIN near USING (uid) ORDER BY n.name = 'Supplier#000000005' DESC, n.uid LIMIT 40", recursive=True)
def _(spark, d):
    return graph.explore(nodes_of(spark, d), edges_of(spark, d), "Supplier#000000005", 2, 40)[0].select("uid", "center")


@query("overview_sample")
def _(spark, d):
    return graph.overview(nodes_of(spark, d), 50).select("uid", "label")


@query("parent_class", graph_sql="SELECT f.uid, min(c.name) AS parent FROM edges e JOIN nodes c ON c.uid = e.src_uid AND c.label = 'Class' JOIN nodes f ON f.uid = e.dst_uid AND f.label = 'Function' WHERE e.type = 'CONTAINS' GROUP BY f.uid")
def _(spark, d):
    return graph.parent_class(nodes_of(spark, d), edges_of(spark, d))


@query("backfill_fqn", graph_sql="""SELECT uid, CASE WHEN label = 'Class' THEN 'x.' || replace(name, '#', '_') ELSE fqn END AS fqn FROM nodes WHERE label IN ('Function', 'Class')""")
def _(spark, d):
    n = nodes_of(spark, d).withColumn("file", F.when(F.col("label") == "Class", F.concat(F.lit("p/src/main/java/x/"), F.replace("name", F.lit("#"), F.lit("_")), F.lit(".java"))).otherwise(F.col("file")))
    return graph.backfill_fqn(n, edges_of(spark, d)).where("label in ('Function', 'Class')").select("uid", "fqn")


@query("list_documents", graph_sql="SELECT a.uid AS doc_uid, a.title AS doc_title, a.file AS doc_file, b.uid, b.title, b.start_line FROM edges e JOIN nodes a ON a.uid = e.src_uid AND a.label = 'Document' JOIN nodes b ON b.uid = e.dst_uid AND b.label = 'Document' WHERE e.type = 'CONTAINS'")
def _(spark, d):
    return graph.document_sections(nodes_of(spark, d), edges_of(spark, d)).select("doc_uid", "doc_title", "doc_file", "uid", "title", "start_line")


@query("documents_nested", graph_sql="SELECT a.uid AS doc_uid, count(*) AS n, min_by(b.title, b.start_line) AS first_title, max_by(b.title, b.start_line) AS last_title FROM edges e JOIN nodes a ON a.uid = e.src_uid AND a.label = 'Document' JOIN nodes b ON b.uid = e.dst_uid WHERE e.type = 'CONTAINS' GROUP BY a.uid")
def _(spark, d):
    return graph.list_documents(nodes_of(spark, d), edges_of(spark, d)).select("doc_uid", F.size("sections").cast("long").alias("n"), F.get("sections", F.lit(0))["title"].alias("first_title"), F.element_at("sections", -1)["title"].alias("last_title"))


@query("get_document", graph_sql="SELECT b.uid, b.title, b.start_line FROM edges e JOIN nodes b ON b.uid = e.dst_uid WHERE e.type = 'CONTAINS' AND e.src_uid = 'Document:src3'")
def _(spark, d):
    return graph.get_document(nodes_of(spark, d), edges_of(spark, d), "Document:src3").select("uid", "title", "start_line")


@query("code_snippet", graph_sql="SELECT uid, label, coalesce(name, '') AS name, coalesce(file, '') AS file, coalesce(signature, '') AS signature, start_line FROM nodes WHERE uid = 'Function:17'")
def _(spark, d):
    return graph.code_snippet(nodes_of(spark, d), "Function:17").select("uid", "label", "name", "file", "signature", "start_line")


@query("graph_stats", graph_sql="""SELECT 'node' AS kind, l AS name, (SELECT count(*) FROM nodes WHERE label = l) AS n FROM (VALUES ('Function'), ('Class'), ('Module'), ('Document')) v(l)
UNION ALL SELECT 'edge', t, (SELECT count(*) FROM edges WHERE type = t) FROM (VALUES ('CONTAINS'), ('CALLS'), ('INHERITS'), ('IMPORTS'), ('REFERENCES')) v(t)""")  # fmt: skip
def _(spark, d):
    return graph.graph_stats(nodes_of(spark, d), edges_of(spark, d))


@query("repository_counts", graph_sql="SELECT repository, count(*) AS n FROM nodes WHERE repository IS NOT NULL GROUP BY repository")
def _(spark, d):
    return graph.repository_counts(nodes_of(spark, d))


@query("repository_samples", graph_sql="SELECT repository, array_to_string(list_sort(list(DISTINCT file))[1:3], ',') AS files FROM nodes WHERE repository IS NOT NULL GROUP BY repository")
def _(spark, d):
    return graph.repository_samples(nodes_of(spark, d)).select("repository", F.array_join("files", ",").alias("files"))


@query("prefix_count", graph_sql="SELECT count(*) AS n FROM nodes WHERE repository = 'repo2' AND starts_with(file, 'Brand#1')")
def _(spark, d):
    return graph.prefix_count(nodes_of(spark, d), "repo2", "Brand#1")


# --- resolution -----------------------------------------------------------------------------


@query("resolve_inherits", sql="SELECT DISTINCT 'Class:' || a.p_partkey AS src_uid, 'Class:' || b.p_partkey AS dst_uid FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) || p_partkey % 997 AS w FROM part) a JOIN (SELECT p_partkey, string_split(p_name, ' ')[1] || p_partkey * 7 % 997 AS name FROM part) b ON a.w = b.name WHERE a.p_partkey <> b.p_partkey")
def _(spark, d):
    part = table(spark, d, "part")
    listing = part.select(F.concat(F.lit("Class:"), "p_partkey").alias("uid"), F.lit("Class").alias("label"), F.lit(None).cast("string").alias("name"), F.transform(F.split("p_name", " "), lambda w: F.concat(w, (F.col("p_partkey") % 997).cast("string"))).alias("base_classes"))
    named = part.select(F.concat(F.lit("Class:"), "p_partkey").alias("uid"), F.lit("Class").alias("label"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), (F.col("p_partkey") * 7 % 997).cast("string")).alias("name"), F.lit(None).cast("array<string>").alias("base_classes"))
    return resolve.inherits(listing.unionByName(named)).select("src_uid", "dst_uid")


@query("resolve_imports", sql="SELECT DISTINCT 'Module:' || s_suppkey AS src_uid, 'Module:' || n_nationkey AS dst_uid FROM supplier JOIN nation ON n_nationkey IN (s_nationkey, (s_nationkey + 1) % 25)")
def _(spark, d):
    asks = table(spark, d, "supplier").select(F.concat(F.lit("Module:"), "s_suppkey").alias("uid"), F.lit("Module").alias("label"), F.lit("").alias("name"), F.array(F.concat(F.lit("a.b.NATION_"), "s_nationkey"), F.concat(F.lit("NATION_"), (F.col("s_nationkey") + 1) % 25)).alias("imports"))
    there = table(spark, d, "nation").select(F.concat(F.lit("Module:"), "n_nationkey").alias("uid"), F.lit("Module").alias("label"), F.col("n_name").alias("name"), F.lit(None).cast("array<string>").alias("imports"))
    own = asks.withColumn("uid", F.concat(F.lit("Module:s"), F.substring("uid", 8, 20)))
    return resolve.imports(own.unionByName(there)).select(F.replace("src_uid", F.lit("Module:s"), F.lit("Module:")).alias("src_uid"), "dst_uid")


@query("resolve_references", graph_sql="SELECT DISTINCT 'Document:' || n_nationkey AS src_uid, b.uid AS dst_uid FROM nation JOIN nodes b ON b.label IN ('Function', 'Class') AND b.name IN (CASE n_nationkey % 3 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red widget' ELSE 'absent' END, 'Supplier#00000000' || (n_nationkey % 10))")
def _(spark, d):
    k = F.col("n_nationkey")
    names = F.array(F.when(k % 3 == 0, "small ring").when(k % 3 == 1, "red widget").otherwise("absent"), F.concat(F.lit("Supplier#00000000"), k % 10))
    docs = table(spark, d, "nation").select(F.concat(F.lit("Document:"), k).alias("uid"), F.lit("Document").alias("label"), names.alias("code_references"))
    code = nodes_of(spark, d).where("label in ('Function', 'Class')")
    return resolve.references(code.unionByName(as_nodes(docs))).select("src_uid", "dst_uid")


_RANGES = "SELECT conv_id, turn, turn * 2 AS s, turn * 2 + 3 + (turn * 7) % 11 AS e FROM conversations"


def _ranges(spark, d):
    t = F.col("turn")
    return table(spark, d, "conversations").select("conv_id", (t * 2).alias("start_line"), (t * 2 + 3 + (t * 7) % 11).alias("end_line"), F.concat(F.lit("f"), t).alias("name"), t.alias("pos"))


@query("innermost_range", sql=f"WITH r AS ({_RANGES}) SELECT c.conv_id, c.turn, c.turn * 3 AS line, (SELECT 'f' || arg_min(r.turn, (r.e - r.s) * 1000 + r.turn) FROM r WHERE r.conv_id = c.conv_id AND c.turn * 3 BETWEEN r.s AND r.e) AS inside FROM conversations c")
def _(spark, d):
    points = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 3).alias("line"))
    return intervals.innermost(points, _ranges(spark, d), "conv_id", "line")


@query("enclosing_range", sql=f"WITH r AS ({_RANGES}) SELECT c.conv_id, c.turn, (SELECT 'f' || max(r.turn) FROM r WHERE r.conv_id = c.conv_id AND c.turn * 3 >= r.s AND c.turn * 3 + 1 <= r.e) AS parent FROM conversations c")
def _(spark, d):
    items = table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 3).alias("start_line"), (F.col("turn") * 3 + 1).alias("end_line"))
    return intervals.enclosing(items, _ranges(spark, d), "conv_id").select("conv_id", "turn", "parent")


@query("resolve_calls", sql="""WITH f AS (SELECT p_brand AS file, p_name AS name, max(p_partkey) AS k FROM part GROUP BY ALL),
s AS (SELECT p_brand AS file, p_name AS caller, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS callee, p_partkey AS line FROM part)
SELECT DISTINCT a.k AS src, b.k AS dst, s.line FROM s JOIN f a ON a.file = s.file AND a.name = s.caller JOIN f b ON b.file = s.file AND b.name = s.callee WHERE s.caller <> s.callee""")  # fmt: skip
def _(spark, d):
    part = table(spark, d, "part")
    functions = part.select(F.col("p_brand").alias("file"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("uid"), F.col("p_partkey").alias("start_line"))
    sites = part.select(F.col("p_brand").alias("file"), F.col("p_name").alias("caller"), F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey")).alias("callee"), F.col("p_partkey").alias("line"))
    return resolve.calls(functions, sites).select(F.col("src_uid").cast("long").alias("src"), F.col("dst_uid").cast("long").alias("dst"), "line")


# --- search ---------------------------------------------------------------------------------


@query("keyword_exact", graph_sql="SELECT uid, name, 1.0::DOUBLE AS score FROM nodes WHERE label IN ('Function', 'Class', 'Module') AND name = 'small ring' ORDER BY uid LIMIT 10")
def _(spark, d):
    return search.keyword_search(nodes_of(spark, d), edges_of(spark, d), "small ring", 10, exact_only=True).select("uid", "name", "score")


@query("keyword_fuzzy", graph_sql="SELECT uid, name, 0.9::DOUBLE AS score FROM nodes WHERE label IN ('Function', 'Class', 'Module') AND contains(lower(name), 'widg') ORDER BY length(name), uid LIMIT 20")
def _(spark, d):
    return search.keyword_search(nodes_of(spark, d), edges_of(spark, d), "Widg", 20).select("uid", "name", "score")


@query("keyword_fqn", graph_sql="SELECT uid, name, 1.0::DOUBLE AS score FROM nodes WHERE fqn = 'a.b.small_ring' ORDER BY uid LIMIT 5")
def _(spark, d):
    return search.keyword_search(nodes_of(spark, d), edges_of(spark, d), "a.b.small_ring", 5).select("uid", "name", "score")


@query("keyword_method", graph_sql="SELECT DISTINCT f.uid, f.name, 0.95::DOUBLE AS score FROM nodes c JOIN edges e ON e.src_uid = c.uid AND e.type = 'CONTAINS' JOIN nodes f ON f.uid = e.dst_uid AND f.label = 'Function' WHERE c.label = 'Class' AND c.name = 'Supplier#000000001' AND f.name = 'red widget'")
def _(spark, d):
    n = nodes_of(spark, d).withColumn("name", F.replace("name", F.lit("Supplier#"), F.lit("Supplier")))
    return search.keyword_search(n, edges_of(spark, d), "Supplier000000001#red widget(int)", 50).select("uid", "name", "score")


@query("keyword_many", graph_sql="""
, words AS (SELECT n_nationkey AS query_id, p AS pos, string_split('red,ring,NATION_1,Supplier#00000000,widget', ',')[p] AS word FROM nation, generate_series(1, 5) g(p)),
hits AS (SELECT w.query_id, w.pos, n.uid, n.name, CASE WHEN n.name = w.word THEN 1.0 ELSE 0.9 END::DOUBLE AS tier FROM words w JOIN nodes n ON n.label IN ('Function', 'Class', 'Module') AND contains(lower(n.name), lower(w.word)))
SELECT query_id, pos, uid, name, tier, row_number() OVER (PARTITION BY query_id, pos ORDER BY tier DESC, CASE WHEN tier < 1 THEN length(name) ELSE 0 END, uid) AS rank FROM hits QUALIFY rank <= 5""")  # fmt: skip
def _(spark, d):
    words = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.posexplode(F.split(F.lit("red,ring,NATION_1,Supplier#00000000,widget"), ",")).alias("p", "word")).select("query_id", (F.col("p") + 1).alias("pos"), "word")
    return search.keyword_search_many(nodes_of(spark, d), words, 5).select("query_id", "pos", "uid", "name", "tier", "rank")


@query("vector_topk", sql="SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def _(spark, d):
    rows = table(spark, d, "embeddings")
    vector = rows.where("vec_id = 0").first()["embedding"]
    return search.vector_search(rows, vector, 10, (), "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("vector_by_label", sql="""WITH s AS (SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 1) q)
SELECT vec_id, label, round(score, 6) AS score FROM s WHERE label IN (1, 2, 3) ORDER BY s.score DESC, vec_id LIMIT 10""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "embeddings")
    return search.vector_search(rows.where("label in (1, 2, 3)"), rows.where("vec_id = 1").first()["embedding"], 10, (), "vec_id").select("vec_id", "label", F.round("score", 6).alias("score"))


@query("vector_topk_many", sql="""SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS rank, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY rank <= 5""")  # fmt: skip
def _(spark, d):
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_search_many(rows.select("vec_id", "embedding"), asked, 5).withColumn("score", F.round("score", 6))


@query("fuse_hits", sql="""WITH k AS (SELECT p_name AS name, p_brand AS file, p_partkey + p_partkey % 2 * 1000000 AS start_line, 0.9 AS score, 0 AS late, p_partkey AS uid FROM part), s AS (SELECT p_name, p_brand, p_partkey, 1.0 - (p_partkey % 100) / 100.0, 1, p_partkey FROM part)
, u AS (SELECT *, row_number() OVER (PARTITION BY name, file, start_line ORDER BY late, score DESC) AS r FROM (SELECT * FROM k UNION ALL SELECT * FROM s))
SELECT name, file, start_line, round(score::DOUBLE, 6) AS score, CASE late WHEN 0 THEN 'keyword' ELSE 'semantic' END AS match_source FROM u WHERE r = 1 ORDER BY u.score DESC, late, uid LIMIT 60""")  # fmt: skip
def _(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("uid"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("start_line"))
    fused = search.fuse(part.withColumn("score", F.lit(0.9)).withColumn("start_line", F.expr("start_line + start_line % 2 * 1000000")), part.withColumn("score", 1 - F.col("uid") % 100 / 100.0), 60)
    return fused.select("name", "file", "start_line", F.round("score", 6).alias("score"), "match_source")


@query("related_context", graph_sql="""
, s AS (SELECT uid, name AS seed FROM nodes WHERE label = 'Class' AND name = 'Supplier#000000002'), walk AS (
  SELECT uid, seed, 0 AS d FROM s UNION SELECT e.src_uid, w.seed, w.d + 1 FROM walk w JOIN edges e ON e.type = 'INHERITS' AND e.dst_uid = w.uid WHERE w.d < 10
), r AS (SELECT s.seed, 3 AS o, e.dst_uid AS uid FROM s JOIN edges e ON e.type = 'CONTAINS' AND e.src_uid = s.uid UNION SELECT seed, 4, uid FROM walk WHERE d > 0)
SELECT any_value(r.seed) AS seed_name, CASE min(o) WHEN 3 THEN 'method' ELSE 'child' END AS relationship, n.name, n.file, n.start_line FROM r JOIN nodes n USING (uid) GROUP BY n.name, n.file, n.start_line""", recursive=True)  # fmt: skip
def _(spark, d):
    n = nodes_of(spark, d)
    return search.related(n, edges_of(spark, d), n.where("name = 'Supplier#000000002'").select("name", F.col("label").alias("type")))


@query("related_calls", graph_sql="""
, s AS (SELECT uid, name AS seed FROM nodes WHERE label = 'Function' AND name IN (SELECT name FROM nodes WHERE uid IN ('Function:7', 'Function:11'))),
out1 AS (SELECT s.seed, e.src_uid, e.dst_uid FROM s JOIN edges e ON e.type = 'CALLS' AND e.src_uid = s.uid),
in1 AS (SELECT s.seed, e.src_uid, e.dst_uid FROM s JOIN edges e ON e.type = 'CALLS' AND e.dst_uid = s.uid),
r AS (SELECT seed, 1 AS o, unnest([src_uid, dst_uid]) AS uid FROM out1 UNION ALL SELECT seed, 2, unnest([src_uid, dst_uid]) FROM in1),
k AS (SELECT r.seed, r.o, n.name, n.file, n.start_line, row_number() OVER (PARTITION BY n.name, n.file, n.start_line ORDER BY o, seed) AS x FROM r JOIN nodes n USING (uid))
SELECT seed AS seed_name, CASE o WHEN 1 THEN 'called_by' ELSE 'calls' END AS relationship, name, file, start_line FROM k WHERE x = 1""")  # fmt: skip
def _(spark, d):
    n = nodes_of(spark, d)
    return search.related(n, edges_of(spark, d), n.where("uid in ('Function:7', 'Function:11')").select("name", F.col("label").alias("type")), 1)


@query("hybrid_search")
def _(spark, d):
    n = nodes_of(spark, d)
    vectors = embed.embed(n, dim=64)
    return search.hybrid_search(vectors, edges_of(spark, d), lambda q: embed.hashed(q, 64), "red widget of Supplier", 5, 1)[0].select("name", "file", "start_line", "match_source")


@query("embed_nodes")
def _(spark, d):
    return embed.embed(nodes_of(spark, d), dim=64).where("embedding is not null").select("uid", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("hash"))


# --- text -----------------------------------------------------------------------------------


@query("identifiers")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.identifiers("text").alias("words")).select("doc_id", F.size("words").alias("n"), F.xxhash64("words").alias("hash"))


@query("qualified_names", sql="SELECT page_id, regexp_extract(url, '[a-zA-Z_]\\w*(\\.[a-zA-Z_]\\w*){2,}') AS fqn FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.qualified_name("url").alias("fqn"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents"


def _headed(spark, d):
    marked = F.transform(F.split("text", "\n"), lambda x: F.when(F.length(x) < 40, F.concat(F.lit("## "), x)).otherwise(x))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array_join(marked, "\n").alias("content"))


@query("sections_markdown", sql=f"""WITH l AS ({_LINES}), h AS (SELECT doc_id, i, trim(line) AS title FROM l WHERE length(line) < 40 AND trim(line) <> '')
SELECT doc_id::VARCHAR AS path, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, i AS start_line, 2 AS level, title FROM h""")  # fmt: skip
def _(spark, d):
    return X.sections(_headed(spark, d)).select("path", "pos", "start_line", "level", "title")


@query("sections_rst", sql=f"""WITH l AS ({_LINES}), h AS (SELECT doc_id, i, trim(line) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM l WHERE length(line) < 40 AND trim(line) <> '')
SELECT doc_id::VARCHAR AS path, pos, i + pos - 1 AS start_line, 2 AS level, title,
  coalesce((SELECT sum(length(x.line) + 1) FROM l x WHERE x.doc_id = h.doc_id AND x.i > h.i AND x.i < coalesce((SELECT min(y.i) FROM h y WHERE y.doc_id = h.doc_id AND y.i > h.i), 1000000)), 0)::BIGINT AS chars FROM h""")  # fmt: skip
def _(spark, d):
    ruled = F.transform(F.split("text", "\n"), lambda x: F.when((F.length(x) < 40) & (F.trim(x) != ""), F.concat(x, F.lit("\n"), F.repeat(F.lit("-"), F.length(x)))).otherwise(x))
    rows = X.sections(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.array_join(ruled, "\n").alias("content")), "rst")
    # a body's characters, with a line end for each of its lines
    return rows.select("path", "pos", "start_line", "level", "title", F.when(F.col("body") == "", 0).otherwise(F.length("body") + 1).cast("long").alias("chars"))


@query("section_levels", sql="""WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 4 = 0 THEN (event_id % 9) || '.' || (event_id % 7) || ' x' ELSE event_type END AS title FROM events),
o AS (SELECT *, CASE WHEN regexp_matches(title, '^\\d') THEN 3 WHEN row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 THEN 1 END AS own FROM t)
SELECT user_id, event_id, last_value(own IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS inferred_level FROM o""")  # fmt: skip
def _(spark, d):
    e = F.col("event_id")
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(e % 4 == 0, F.concat((e % 9).cast("string"), F.lit("."), (e % 7).cast("string"), F.lit(" x"))).otherwise(F.col("event_type")).alias("title"))
    return X.section_levels(rows, "user_id", "event_id").select("user_id", "event_id", "inferred_level")


@query("content_hash", sql="SELECT doc_id, left(sha256(text), 16) AS content_hash FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash("text").alias("content_hash"))


@query("java_fqn", sql="SELECT n_nationkey, 'x.' || n_name AS class_fqn, 'x.' || n_name || '#m' AS method_fqn, 'x.m' AS free_fqn, '' AS none FROM nation")
def _(spark, d):
    path = F.concat(F.lit("/r/src/test/java/x/"), "n_name", F.lit(".java"))
    return table(spark, d, "nation").select("n_nationkey", X.java_fqn(path, F.lit("K")).alias("class_fqn"), X.java_fqn(path, F.lit("m"), True, F.lit("K")).alias("method_fqn"), X.java_fqn(path, F.lit("m"), True, F.lit("")).alias("free_fqn"), X.java_fqn("n_name", F.lit("m")).alias("none"))


@query("paths", sql="SELECT page_id, split_part(url, '/', -1) AS last, CASE WHEN position('/en/' IN url) > 0 THEN substring(url, position('/en/' IN url) + 4) ELSE url END AS relative, CASE WHEN position('/en/' IN url) > 0 THEN left(url, position('/en/' IN url) + 2) END AS root FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", X.last_segment("url", "/").alias("last"), X.relative_path("url", F.lit("en")).alias("relative"), X.repository_root("url", F.lit("en")).alias("root"))


@query("code_text", graph_sql="SELECT uid, 'Name: ' || name || CASE WHEN coalesce(signature, '') <> '' THEN chr(10) || 'Signature: ' || signature ELSE '' END || CASE WHEN coalesce(content, '') <> '' THEN chr(10) || 'Description: ' || left(content, 500) || chr(10) || 'Code: ' || left(content, 1000) ELSE '' END AS text FROM nodes")
def _(spark, d):
    return nodes_of(spark, d).select("uid", X.code_text("name", "signature", "content", "content").alias("text"))


@query("code_references", sql="""SELECT p_partkey, array_to_string(list_sort(list_distinct([string_split(p_name, ' ')[1], string_split(p_name, ' ')[2]])), ',') AS refs FROM part WHERE length(string_split(p_name, ' ')[1]) > 2 AND length(string_split(p_name, ' ')[2]) > 2 AND regexp_matches(p_name, '^[a-z]+ [a-z]+$')""")
def _(spark, d):
    part = table(spark, d, "part").where(r"p_name rlike '^[a-z]{3,} [a-z]{3,}$'")
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(k)) for k in (1, 2))
    text = F.concat(F.lit("see `"), a, F.lit("` and `x.y."), b, F.lit("`, `no`\n```\n`fenced_name`\n```\n"))
    return part.select("p_partkey", F.array_join(X.code_references(text), ",").alias("refs"))


@query("uid_compose", sql="SELECT p_partkey, 'Function:' || p_brand || ':' || p_name || ':' || p_partkey AS uid, 'Module:::0' AS empty FROM part")
def _(spark, d):
    null = F.lit(None).cast("string")
    return table(spark, d, "part").select("p_partkey", uid(F.lit("Function"), F.col("p_brand"), F.col("p_name"), F.col("p_partkey")).alias("uid"), uid(F.lit("Module"), null, null, null).alias("empty"))


@query("excluded_paths", sql="SELECT n_nationkey, n_nationkey % 3 = 0 AS excluded FROM nation")
def _(spark, d):
    path = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("a/node_modules/"), "n_name")).otherwise(F.concat(F.lit("a/my_modules/"), "n_name"))
    return table(spark, d, "nation").select("n_nationkey", X.excluded(path).alias("excluded"))


# --- changes --------------------------------------------------------------------------------


@query("upsert_nodes", graph_sql="SELECT uid, label, name, CASE WHEN label = 'Function' AND start_line % 2 = 0 THEN 'new' ELSE signature END AS signature, file FROM nodes UNION ALL SELECT 'Function:new', 'Function', 'fresh', 'new', NULL")
def _(spark, d):
    n = nodes_of(spark, d)
    changed = n.where("label = 'Function' and start_line % 2 = 0").select("uid", "label", F.lit(None).cast("string").alias("name"), F.lit("new").alias("signature"))
    added = spark.createDataFrame([("Function:new", "Function", "fresh", "new")], "uid string, label string, name string, signature string")
    return mutate.upsert_nodes(n, changed.unionByName(added)).select("uid", "label", "name", "signature", "file")


@query("upsert_edges", graph_sql="SELECT src_uid, dst_uid, type, line FROM edges UNION SELECT 'Function:' || p_partkey, 'Function:' || (p_partkey + 1), 'CALLS', 9 FROM part WHERE p_partkey + 1 < (SELECT count(*) FROM part)")
def _(spark, d):
    p = F.col("p_partkey")
    new = table(spark, d, "part").select(F.concat(F.lit("Function:"), p).alias("src_uid"), F.concat(F.lit("Function:"), p + 1).alias("dst_uid"), F.lit("CALLS").alias("type"), F.lit(9).cast("long").alias("line"))
    return mutate.upsert_edges(edges_of(spark, d), new, nodes_of(spark, d))


_GONE = "SELECT uid FROM nodes WHERE file IN ('Brand#3', 'src1') OR path = 'src/NATION_2.py'"


def _deleted(spark, d):
    files = spark.createDataFrame([("Brand#3",), ("src1",), ("src/NATION_2.py",)], "file string")
    return mutate.delete_files(nodes_of(spark, d), edges_of(spark, d), files)


@query("delete_files_nodes", graph_sql=f"SELECT uid, label FROM nodes WHERE uid NOT IN ({_GONE})")
def _(spark, d):
    return _deleted(spark, d)[0].select("uid", "label")


@query("delete_files_edges", graph_sql=f"SELECT src_uid, dst_uid, type, line FROM edges WHERE src_uid NOT IN ({_GONE}) AND dst_uid NOT IN ({_GONE})")
def _(spark, d):
    return _deleted(spark, d)[1]


@query("delete_repository", graph_sql="SELECT uid FROM nodes WHERE repository IS DISTINCT FROM 'repo3'")
def _(spark, d):
    return mutate.delete_nodes(nodes_of(spark, d), edges_of(spark, d), F.col("repository") == "repo3")[0].select("uid")


@query("cleanup_folders", graph_sql="SELECT uid FROM nodes WHERE coalesce(file, path) NOT IN ('Brand#4') AND path IS NULL")
def _(spark, d):
    n = nodes_of(spark, d).withColumn("file", F.when(F.col("file") == "Brand#4", F.lit("build/x.py")).otherwise(F.col("file")))
    return mutate.delete_nodes(n, edges_of(spark, d), mutate.in_folders(("build", "src")))[0].select("uid")


@query("tag_unowned", graph_sql="SELECT uid, CASE WHEN repository IS NULL AND starts_with(file, 'src1') THEN 'docs' ELSE repository END AS repository FROM nodes")
def _(spark, d):
    return mutate.tag_unowned(nodes_of(spark, d), "docs", "src1").select("uid", "repository")


@query("strip_prefix", graph_sql="SELECT uid, file, CASE WHEN path IS NOT NULL THEN substring(path, 5) END AS path FROM nodes")
def _(spark, d):
    return mutate.strip_prefix(nodes_of(spark, d), edges_of(spark, d), "src/")[0].select("uid", "file", "path")


_LAST = "SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id"


@query("last_change", sql=_LAST)
def _(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return last_of_each(rows).select(F.col("path").cast("long").alias("user_id"), F.col("status").alias("event_type"), F.col("seq").alias("event_id"))


@query("change_counts", sql="SELECT count(*) FILTER (event_id % 3 = 0) AS added, count(*) FILTER (event_id % 3 = 1) AS modified, count(*) FILTER (event_id % 3 = 2) AS deleted FROM events")
def _(spark, d):
    k = F.col("event_id") % 3
    return changes.status_counts(table(spark, d, "events").select(F.when(k == 0, "A").when(k == 1, "M").otherwise("D").alias("status")))


@query("parse_sources")
def _(spark, d):
    p = F.col("p_partkey").cast("string")
    python = F.concat(F.lit("import os\nclass C"), p, F.lit(":\n    def m"), p, F.lit("(self):\n        helper()\ndef helper():\n    pass\n"))
    sources = table(spark, d, "part").select(F.concat(F.lit("src/f"), p, F.lit(".py")).alias("path"), python.alias("content"))
    return scan.entities(sources).select("path", "kind", "name", "start_line", "end_line", "owner")


ORACLES["parse_sources"] = """SELECT 'src/f' || p_partkey || '.py' AS path, kind, replace(name, '@', p_partkey::VARCHAR) AS name, start_line, end_line, replace(owner, '@', p_partkey::VARCHAR) AS owner FROM part,
(VALUES ('class', 'C@', 2, 4, NULL), ('function', 'm@', 3, 4, 'C@'), ('function', 'helper', 5, 6, NULL), ('import', 'os', 0, 0, NULL), ('call', 'helper', 4, 4, 'm@')) v(kind, name, start_line, end_line, owner)"""
