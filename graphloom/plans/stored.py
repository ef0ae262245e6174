"""Registered queries through a written store: the derived graph is stored, changed by small commits, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutate, resolve, search, traverse, vector_index
from ..schema import EDGES, as_edges, as_nodes
from ..sources import scan
from .corpora import CODE, sources_of
from .derived import _GONE, ORACLES, edges_of, nodes_of, query, table
from .engine import Engine
from .store import GraphStore


def _new(spark: SparkSession) -> GraphStore:
    return GraphStore(spark, f"{traverse._shared(spark)}/stored-{uuid.uuid4().hex}")


def stored(spark: SparkSession, d: str) -> GraphStore:
    """A store that holds the derived graph."""
    store = _new(spark)
    store.write(nodes_of(spark, d), edges_of(spark, d))
    return store


def _upsert(store: GraphStore, d: str) -> None:
    spark, n = store.spark, store.nodes()
    changed = n.where("label = 'Function' and start_line % 2 = 0").select("uid", "label", F.lit(None).cast("string").alias("name"), F.lit("new").alias("signature"), F.lit(None).cast("string").alias("file"))
    added = spark.createDataFrame([("Function:new", "Function", "fresh", None, "new")], "uid string, label string, name string, signature string, file string")
    p = F.col("p_partkey")
    edges = table(spark, d, "part").select(F.concat(F.lit("Function:"), p).alias("src_uid"), F.concat(F.lit("Function:"), p + 1).alias("dst_uid"), F.lit("CALLS").alias("type"), F.lit(9).cast("long").alias("line"))
    store.upsert(changed.unionByName(added), edges)


_MERGED = "SELECT uid, label, name, CASE WHEN label = 'Function' AND start_line % 2 = 0 THEN 'new' ELSE signature END AS signature, file FROM nodes UNION ALL SELECT 'Function:new', 'Function', 'fresh', NULL, 'new'"


@query("store_upsert", graph_sql=_MERGED)
def _(spark: SparkSession, d: str) -> DataFrame:
    store = stored(spark, d)
    _upsert(store, d)
    return store.nodes().select("uid", "label", "name", "signature", "file")


@query("store_upsert_edges", sql=ORACLES["upsert_edges"])
def _(spark: SparkSession, d: str) -> DataFrame:
    store = stored(spark, d)
    _upsert(store, d)
    return store.edges()


def _delete(store: GraphStore) -> None:
    store.delete(mutate.of_files(["Brand#3", "src1", "src/NATION_2.py"]))


@query("store_delete", sql=ORACLES["delete_files_nodes"])
def _(spark: SparkSession, d: str) -> DataFrame:
    store = stored(spark, d)
    _delete(store)
    return store.nodes().select("uid", "label")


@query("store_delete_edges", sql=ORACLES["delete_files_edges"])
def _(spark: SparkSession, d: str) -> DataFrame:
    store = stored(spark, d)
    _delete(store)
    return store.edges()


@query("store_tag", sql=ORACLES["tag_unowned"])
def _(spark: SparkSession, d: str) -> DataFrame:
    store = stored(spark, d)
    store.tag("docs", "src1")
    return store.nodes().select("uid", "repository")


@query("store_compacted", graph_sql=f"SELECT * FROM ({_MERGED}) WHERE uid NOT IN ({_GONE})")
def _(spark: SparkSession, d: str) -> DataFrame:
    store = stored(spark, d)
    _upsert(store, d)
    _delete(store)
    store.compact()
    return store.nodes().select("uid", "label", "name", "signature", "file")


@query("resolve_delta", sql=f"""WITH {CODE}, kept AS (SELECT * FROM code WHERE language <> 'go')
SELECT src_uid, dst_uid, type, line FROM links WHERE src_uid IN (SELECT uid FROM kept)
UNION ALL SELECT a.uid, b.uid, 'INHERITS', NULL FROM kept a JOIN kept b ON b.label = 'Class' AND b.name = a.bases AND a.uid <> b.uid WHERE a.label = 'Class'
UNION ALL SELECT a.uid, b.uid, 'IMPORTS', NULL FROM kept a, unnest(string_split(a.imports, ',')) u(raw), kept b WHERE a.label = 'Module' AND b.label = 'Module' AND b.name = string_split(raw, '.')[-1] AND a.uid <> b.uid""")  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    """Three commits: all without Java's bases and any imports, then those, then no Go files; edges across files follow by deltas alone."""
    sources, store = sources_of(spark, d), _new(spark)
    nodes, edges = (traverse.cut(x) for x in scan.code_graph(sources))
    java = F.coalesce(F.col("language") == "java", F.lit(False))
    store.ingest(nodes.withColumn("base_classes", F.when(~java, F.col("base_classes"))).withColumn("imports", F.lit(None).cast("array<string>")), edges)
    store.ingest(nodes.where(java | (F.col("label") == "Module")), edges.limit(0))
    store.ingest(nodes.limit(0), edges.limit(0), sources.where(F.col("path").endswith(".go")).select(F.col("path").alias("file")))
    return store.edges()


@query("keyword_indexed", sql=ORACLES["keyword_fuzzy"])
def _(spark: SparkSession, d: str) -> DataFrame:
    now = stored(spark, d).at()
    return search.keyword_search(now.holding("widg"), now.edges(), "widg", 20).select("uid", "name", "score")


_TIERS = """
, words AS (SELECT p_partkey AS query_id, 1 AS pos, CASE p_partkey % 4 WHEN 0 THEN 'a.b.' || replace(p_name, ' ', '_') WHEN 1 THEN 'x.C' || (p_partkey % (SELECT count(*) FROM supplier)) || '#' || p_name || '(int)' WHEN 2 THEN p_name ELSE 'no.such.name' || p_partkey END AS word FROM part),
f AS (SELECT query_id, pos, uid, name, 1.0 AS tier FROM words JOIN nodes ON fqn = word),
m AS (SELECT query_id, pos, n.uid, n.name, 0.95 AS tier FROM words w JOIN edges e ON e.type = 'CONTAINS' AND w.query_id % 4 = 1 AND e.src_uid = 'Class:' || (w.query_id % (SELECT count(*) FROM supplier)) JOIN nodes n ON n.uid = e.dst_uid AND n.label = 'Function' AND n.name = (SELECT p_name FROM part WHERE p_partkey = w.query_id)),
g AS (SELECT query_id, pos, n.uid, n.name, CASE WHEN n.name = word THEN 1.0 ELSE 0.9 END AS tier FROM words w JOIN nodes n ON n.label IN ('Function', 'Class', 'Module') AND contains(lower(n.name), lower(word)) WHERE w.query_id % 4 > 1),
hits AS (SELECT * FROM f UNION ALL SELECT * FROM m UNION ALL SELECT * FROM g)
SELECT query_id, pos, uid, name, tier::DOUBLE AS tier, row_number() OVER (PARTITION BY query_id, pos ORDER BY tier DESC, CASE WHEN tier = 0.9 THEN length(name) ELSE 0 END, uid)::INTEGER AS rank FROM hits QUALIFY rank <= 3"""


@query("keyword_many_tiers", graph_sql=_TIERS)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Of each part a word: a qualified name, a class's method, a name, or what nothing bears."""
    nodes, key = nodes_of(spark, d), F.col("p_partkey")
    n = nodes.withColumn("name", F.when(F.col("label") == "Class", F.concat(F.lit("C"), F.substring_index("uid", ":", -1))).otherwise(F.col("name")))
    suppliers = table(spark, d, "supplier").count()
    method = F.concat(F.lit("x.C"), (key % suppliers).cast("string"), F.lit("#"), "p_name", F.lit("(int)"))
    word = F.when(key % 4 == 0, F.concat(F.lit("a.b."), F.replace("p_name", F.lit(" "), F.lit("_")))).when(key % 4 == 1, method).when(key % 4 == 2, F.col("p_name")).otherwise(F.concat(F.lit("no.such.name"), key.cast("string")))
    words = table(spark, d, "part").select(key.alias("query_id"), F.lit(1).alias("pos"), word.alias("word"))
    return search.keyword_search_many(n, words, 3, edges_of(spark, d)).select("query_id", "pos", "uid", "name", "tier", "rank")


@query("index_applied", sql=f"WITH {CODE} SELECT uid, label, name FROM code WHERE language <> 'go'")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All files in one change through the engine, then Go's deleted, JavaScript's changed to nothing and back."""
    engine, sources = Engine(_new(spark), dim=8), sources_of(spark, d)
    changed = lambda kind, status, content: sources.where(F.col("path").endswith(kind)).select("path", F.lit(status).alias("status"), content.alias("content"))
    engine.apply(sources.withColumn("status", F.lit("A")))
    engine.apply(changed(".go", "D", F.lit(None).cast("string")).unionByName(changed(".js", "M", F.lit("// nothing"))))
    engine.apply(changed(".js", "M", F.col("content")))
    return engine.store.nodes().select("uid", "label", "name")


@query("lookup_file", sql=ORACLES["file_entities"])
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(spark, d).at().lookup((resolve.FILE,), ["Brand#12"])
    return rows.where(F.col("label").isin("Function", "Class")).select(F.col("label").alias("type"), "name", "start_line", F.coalesce("signature", F.lit("")).alias("signature"))


def _indexed(spark: SparkSession, d: str) -> tuple[DataFrame, vector_index.VectorIndex]:
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    return rows, vector_index.build(rows, f"{traverse._shared(spark)}/vectors-{uuid.uuid4().hex}", "vec_id")


@query("vector_index_topk", sql=ORACLES["vector_topk"])
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, index = _indexed(spark, d)
    return index.nearest(rows.where("vec_id = 0").first()["embedding"], 10).select("vec_id", F.round("score", 6).alias("score"))


@query("vector_index_by_label", sql=ORACLES["vector_by_label"].replace("SELECT vec_id, label,", "SELECT vec_id, label::VARCHAR AS label,"))
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, index = _indexed(spark, d)
    return index.nearest(rows.where("vec_id = 1").first()["embedding"], 10, ("1", "2", "3")).select("vec_id", "label", F.round("score", 6).alias("score"))


@query("vector_index_many", sql=ORACLES["vector_topk_many"])
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, index = _indexed(spark, d)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return index.nearest_many(asked, 5).withColumn("score", F.round("score", 6))


@query("store_nearest", sql="""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1),
now AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN -1 ELSE 1 END) * list_cosine_similarity(embedding::DOUBLE[], q.v) AS cosine FROM embeddings, q WHERE vec_id % 11 <> 0)
SELECT 'Function:' || vec_id AS uid, round(cosine, 6) AS score FROM now ORDER BY cosine DESC, uid LIMIT 20""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """By the index of the base, after a commit that turns some vectors round and one that deletes some."""
    rows, store = table(spark, d, "embeddings"), _new(spark)
    node = F.concat(F.lit("Function:"), "vec_id").alias("uid"), F.lit("Function").alias("label")
    turned = F.transform("embedding", lambda x: -x).alias("embedding")
    store.write(as_nodes(rows.select(*node, "embedding")), as_edges(spark.createDataFrame([], EDGES)))
    store.upsert(as_nodes(rows.where("vec_id % 7 = 0").select(*node, turned)), spark.createDataFrame([], EDGES))
    store.delete(F.substring_index("uid", ":", -1).cast("long") % 11 == 0)
    now = store.at()
    return now.nearest(now.nodes(), rows.where("vec_id = 1").first()["embedding"], 20).select("uid", F.round("score", 6).alias("score"))
