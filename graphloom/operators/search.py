"""Keyword, vector and hybrid search over nodes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import VECTOR_LABELS
from . import graph, resolve, traverse

HITS = "uid string, type string, name string, file string, start_line long, signature string, docstring string, score double"


def _hit(score: Column) -> list[Column]:
    texts = [graph.empty(c).alias(c) for c in ("file", "signature", "docstring")]
    return ["uid", F.col("label").alias("type"), "name", texts[0], "start_line", texts[1], texts[2], score.alias("score")]


def keyword_search(nodes: DataFrame, edges: DataFrame, keyword: str, k: int = 10, exact_only: bool = False) -> DataFrame:
    """Up to `k` code nodes that match a keyword, best tier first; uid breaks ties.

    A qualified name takes exact matches of fqn alone (1.0); without any, one with # takes the
    class's method of that name (0.95). Else exact names (1.0), and unless `exact_only` or `k` are
    found names that hold the keyword in any case, short ones first (0.9). Documents are never found.
    The tiers are one scan with a rank; only the method tier joins.
    """
    key = keyword.strip()
    code = nodes.where(F.col("label").isin(*graph.CODE))
    if "#" in key or (key.count(".") >= 2 and " " not in key):
        exact = code.where(F.col("fqn") == key).select(*_hit(F.lit(1.0)))
        if not exact.isEmpty():
            return exact.orderBy("uid").limit(k)
        if "#" in key:
            owner, _, method = key.partition("#")
            owners = code.where((F.col("label") == "Class") & (F.col("name") == owner.rsplit(".", 1)[-1]))
            methods = code.where((F.col("label") == "Function") & (F.col("name") == method.split("(")[0].strip()))
            pairs = graph.expand(owners, edges, methods, "CONTAINS").select(*_hit(F.lit(0.95))).dropDuplicates(["uid"])
            if not pairs.isEmpty():
                return pairs.orderBy("uid").limit(k)
    equal = F.col("name") == key
    holds = F.lower("name").contains(key.lower())
    tier = F.when(equal, 0).when(F.lit(not exact_only) & holds, 1)
    ranked = code.withColumn("_tier", tier).where("_tier is not null").dropDuplicates(["uid"])
    ranked = ranked.orderBy("_tier", F.when(F.col("_tier") == 1, F.length("name")).otherwise(0), "uid").limit(k)
    return ranked.select(*_hit(F.when(F.col("_tier") == 0, 1.0).otherwise(0.9)))


def keyword_search_many(nodes: DataFrame, words: DataFrame, k: int = 10, edges: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, uid, name, tier, rank, ...): the tiers of `keyword_search` for many keywords (query_id, pos, word) at once, `k` of each.

    Words with # or two dots and no space take exact qualified names alone (1.0); those with # that
    find none, the class's methods of that name (0.95), where edges are given; words left over take
    names. Each distinct word is looked up once, and of the nodes of one name or qualified name only
    the first `k` go on, so neither words that are asked for often nor names that many nodes bear
    make more rows. A query's position has one word.
    """
    code = nodes.where(F.col("label").isin(*graph.CODE)).select("name", "uid", "label", "file", "start_line", "fqn")
    asked = traverse.cut(words.select("query_id", "pos", F.trim("word").alias("word")))
    each = traverse.cut(asked.where("word is not null").select("word").distinct())
    word = F.col("word")
    hashed = word.contains("#")
    qualified = each.where(hashed | ((F.length(word) - F.length(F.replace(word, F.lit(".")))) >= 2) & ~word.contains(" "))
    exact = _first_of(code.where("fqn is not null"), "fqn", k).join(traverse.sized(qualified), F.col("fqn") == word).withColumn("tier", F.lit(1.0))
    exact = traverse.cut(exact)
    found, done = exact, exact.select("word").distinct()
    if edges is not None:
        parts = [F.substring_index(F.substring_index(word, "#", 1), ".", -1), F.trim(F.substring_index(F.regexp_extract(word, "#(.*)", 1), "(", 1))]
        split = qualified.where(hashed).join(done, "word", "left_anti").select("word", parts[0].alias("_owner"), parts[1].alias("_method"))
        owners = code.where("label = 'Class'").select(F.col("name").alias("_owner"), F.col("uid").alias("src_uid"))
        owners = traverse.cut(owners.join(split, "_owner").select("src_uid", "_method", "word"))
        held = edges.where("type = 'CONTAINS'").select("src_uid", F.col("dst_uid").alias("uid")).join(traverse.sized(owners.select("src_uid").distinct()), "src_uid", "left_semi")
        # a class's methods meet its words by name, not each of them each word
        methods = code.where("label = 'Function'").join(held, "uid").join(traverse.sized(owners), (held["src_uid"] == owners["src_uid"]) & (F.col("name") == F.col("_method")))
        methods = traverse.cut(methods.dropDuplicates(["word", "uid"]).select(*code.columns, "word").withColumn("tier", F.lit(0.95)))
        found, done = found.unionByName(methods), done.unionByName(methods.select("word").distinct())
    plain = traverse.cut(each.join(done, "word", "left_anti"))
    rows = found.unionByName(_names_of_words(code, plain, k).select(*code.columns, "word", "tier"))
    order = Window.partitionBy("word").orderBy(F.desc("tier"), F.when(F.col("tier") == 0.9, F.length("name")).otherwise(0), "uid")
    best = traverse.cut(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    return asked.join(traverse.sized(best), "word").select(*code.columns, "query_id", "pos", "word", "tier", "rank")


def _first_of(code: DataFrame, by: str, k: int) -> DataFrame:
    """Of the nodes of one value of a column the first `k` by uid; tasks keep their own first ones before they are dealt out."""
    return code.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy("uid"))).where(F.col("_n") <= k).drop("_n")


def _names_of_words(code: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The nodes of the `k` names and more that each distinct word may need: exact ones (1.0) and those that hold it (0.9)."""
    # of a word's names those that its best `k` nodes can bear: as each has a node, `k` names are enough
    tier = F.when(F.col("name") == F.col("word"), 1.0).otherwise(0.9)
    met = _holding(code, asked).withColumn("tier", tier).withColumn("_long", F.when(F.col("tier") < 1, F.length("name")).otherwise(0))
    some = Window.partitionBy("word").orderBy(F.desc("tier"), "_long")
    met = traverse.cut(met.withColumn("_n", F.rank().over(some)).where(F.col("_n") <= k).drop("_n", "_long"))
    borne = code.join(traverse.sized(met.select("name").distinct()), "name", "left_semi")
    return _first_of(borne, "name", k).join(traverse.sized(met), "name")


def _holding(code: DataFrame, words: DataFrame) -> DataFrame:
    """(name, word): the distinct names that hold each word in any case.

    A word meets only the names that hold that three letters of it which the fewest names hold, and
    none where some three letters of it are in no name; what it meets is verified. Words of one or
    two letters, of which there are few, meet all names.
    """
    low, holds = F.lower("word"), F.lower("name").contains(F.lower("word"))
    names = code.select("name").where("name is not null").distinct()
    short = names.join(traverse.sized(words.where(F.length(low) < 3)), holds)
    lists = traverse.cut(resolve.grams(code))
    own = words.where(F.length(low) >= 3).select("word", F.explode(resolve.triples(low)).alias("gram"))
    many = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("_many"))
    rare = own.join(traverse.sized(many), "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("_many", F.lit(0)).alias("many"), "gram")).alias("_rare"))
    rare = traverse.cut(rare.where("_rare.many > 0").select("word", F.col("_rare.gram").alias("gram")))
    return short.unionByName(lists.join(traverse.sized(rare), "gram").where(holds).select("name", "word"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null where one is zero or null."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(size(a) * size(b), F.lit(0.0))


def vector_search(nodes: DataFrame, vector: list[float], k: int = 10, labels: tuple[str, ...] = VECTOR_LABELS, id_col: str = "uid") -> DataFrame:
    """The `k` rows of largest cosine similarity, exact: one scan, a top-k in each task; the id breaks ties."""
    rows = nodes.where(F.col("label").isin(*labels)) if labels else nodes
    score = cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in vector)))
    return rows.where("embedding is not null").withColumn("score", score).where("score is not null and not isnan(score)").orderBy(F.desc("score"), id_col).limit(k)


def vector_search_many(rows: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """(query_id, rank, id, score) for a stated set of queries (query_id, vector) against all rows; each keeps its best `k`.

    Blocks of at most QUERIES queries are sent to all executors, where each Arrow batch of rows is
    one matrix product with them; a task keeps its best `k` of each query, ties included, and a
    window the best of all. More blocks are further scans, never a product of two tables.
    """
    asked = queries.where("vector is not null")
    blocks = max(1, -(-asked.count() // (QUERIES * 3 // 4)))
    found = None
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).select("query_id", "vector").toPandas() if blocks > 1 else asked.select("query_id", "vector").toPandas()
        for _, part in own.groupby(own["vector"].map(len)):
            near = _near(rows, part["query_id"].tolist(), np.array(part["vector"].tolist(), float), k, id_col, queries.schema["query_id"].dataType.simpleString())
            found = near if found is None else found.unionByName(near)
    if found is None:
        kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}[id_col]
        return rows.sparkSession.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, `{id_col}` {kind}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def _near(rows: DataFrame, names: list, vectors: np.ndarray, k: int, id_col: str, kind: str) -> DataFrame:
    """(query_id, id, score) of the best `k` of each task for each query; rows of another length, or without one, have no score."""
    size = np.linalg.norm(vectors, axis=1)
    names = [n for n, s in zip(names, size, strict=True) if s > 0]
    units = vectors[size > 0] / size[size > 0, None]

    def best(held: pd.DataFrame) -> pd.DataFrame:
        return held.sort_values(["q", "score", id_col], ascending=[True, False, True], kind="stable").groupby("q", sort=False).head(k)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0
        for batch in batches:
            own = batch.to_pandas()
            own = own[own["embedding"].map(lambda v: v is not None and len(v) == units.shape[1])]
            if not len(own):
                continue
            matrix = np.array(own["embedding"].tolist(), float)
            length = np.linalg.norm(matrix, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                matrix = matrix / length[:, None]
            sound = np.isfinite(matrix).all(axis=1)
            matrix, ids = matrix[sound], own[id_col].to_numpy()[sound]
            for at in range(0, len(units), 512):
                score = units[at : at + 512] @ matrix.T
                if score.shape[1] > k:
                    cut = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - 1e-12
                    q, row = np.nonzero(score >= cut[:, None])
                else:
                    q, row = (x.ravel() for x in np.indices(score.shape))
                # again, as one sum for each pair, so that equal vectors have equal scores
                held.append(pd.DataFrame({"q": q + at, id_col: ids[row], "score": (units[q + at] * matrix[row]).sum(axis=1)}))
                fresh += len(q)
            if fresh > 1_000_000:
                held, fresh = [best(pd.concat(held))], 0
        if held:
            out = best(pd.concat(held))
            columns = [pa.array([names[q] for q in out["q"]]), pa.array(out[id_col]), pa.array(out["score"], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", id_col, "score"])

    own_kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}[id_col]
    return rows.select(id_col, "embedding").mapInArrow(work, f"query_id {kind}, `{id_col}` {own_kind}, score double")


#: Queries that are sent to all executors at once.
QUERIES = 4096


def semantic_search(nodes: DataFrame, encode: Callable[[str], list[float]], query: str, k: int = 10, labels: tuple[str, ...] = VECTOR_LABELS, find: Callable[..., DataFrame] = vector_search) -> DataFrame:
    """Nodes nearest to a question: docstrings cut to 200 characters, contents to 500; empty if it cannot be encoded. `find` looks for them, as `vector_search` does."""
    try:
        vector = encode(query)
    except (ValueError, RuntimeError, OSError):
        vector = None
    if not vector:
        return nodes.sparkSession.createDataFrame([], HITS + ", content string")
    found = find(nodes, vector, k, labels)
    return found.select("uid", F.col("label").alias("type"), "name", graph.empty("file").alias("file"), "start_line", F.when(F.col("label") == "Function", graph.empty("signature")).otherwise("").alias("signature"), F.left(graph.empty("docstring"), F.lit(200)).alias("docstring"), "score", F.when(F.col("label") == "Document", F.left(graph.empty("content"), F.lit(500))).alias("content"))


def fuse(keyword: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """Both hit lists, one row per name, file and line, keyword rows first; the best `k` by score, keyword rows first on ties."""
    a = keyword.withColumn("match_source", F.lit("keyword"))
    b = semantic.withColumn("match_source", F.lit("semantic"))
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_late", (F.col("match_source") != "keyword").cast("int"))
    first = Window.partitionBy("name", "file", "start_line").orderBy("_late", F.desc("score"), "uid")
    kept = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.orderBy(F.desc("score"), "_late", "uid").limit(k).drop("_n", "_late")


def related(nodes: DataFrame, edges: DataFrame, hits: DataFrame, depth: int = 2, callers: bool = True, callees: bool = True) -> DataFrame:
    """(seed_name, relationship, name, file, start_line) around hits: of functions the calls within `depth`, of classes methods and children.

    What a function reaches is labelled called_by, what reaches it calls; the seeds themselves may
    be among the rows. All seeds walk together.
    """
    seeds = nodes.join(hits.select("name", "type").distinct(), (nodes["name"] == hits["name"]) & (nodes["label"] == hits["type"]), "left_semi").select("uid", "label", F.col("name").alias("seed"))
    functions, classes = seeds.where("label = 'Function'"), seeds.where("label = 'Class'")
    calls = graph.of_type(edges, "CALLS")
    out = []
    for on, direction, name in ((callees, "out", "called_by"), (callers, "in", "calls")):
        if on:
            reached = traverse.path_edges(functions.select("seed", "uid"), calls, depth, direction)
            both = reached.select("seed", F.explode(F.array("src_uid", "dst_uid")).alias("uid"))
            out.append(both.withColumn("relationship", F.lit(name)))
    methods = graph.of_type(edges, "CONTAINS").join(classes.select(F.col("uid").alias("src_uid"), "seed"), "src_uid").select("seed", F.col("dst_uid").alias("uid"), F.lit("method").alias("relationship"))
    children = traverse.distances(classes.select("seed", "uid"), graph.of_type(edges, "INHERITS"), 10, "in").where("dist > 0").select("seed", "uid", F.lit("child").alias("relationship"))
    for x in (methods, children):
        out.append(x)
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    known = nodes.select("uid", "name", graph.empty("file").alias("file"), "start_line")
    found = rows.distinct().join(known, "uid").select(F.col("seed").alias("seed_name"), "relationship", "name", "file", "start_line")
    order = F.array_position(F.array(*map(F.lit, ("called_by", "calls", "method", "child"))), F.col("relationship"))
    first = Window.partitionBy("name", "file", "start_line").orderBy(order, "seed_name")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def words_of(spark, query: str) -> list[str]:
    """A qualified name in a question, else its identifiers; parsed by the same expressions that serve columns."""
    row = spark.createDataFrame([(query,)], "q string").select(X.qualified_name("q").alias("fqn"), X.identifiers("q").alias("words")).first()
    return [row["fqn"]] if row["fqn"] else list(row["words"])


def hybrid_search(nodes: DataFrame, edges: DataFrame, encode: Callable[[str], list[float]], query: str, k: int = 5, depth: int = 2, callers: bool = True, callees: bool = True, fallback: bool = False, find: Callable[..., DataFrame] = vector_search) -> tuple[DataFrame, DataFrame]:
    """(hits, context): the question's first three identifiers and its vector, fused, and what the graph has around the hits."""
    words = words_of(nodes.sparkSession, query)[:3] or ([query] if fallback else [])
    hits = None
    for pos, word in enumerate(words):
        rows = keyword_search(nodes, edges, word, k).withColumn("_pos", F.lit(pos))
        hits = rows if hits is None else hits.unionByName(rows)
    if hits is None:
        hits = nodes.sparkSession.createDataFrame([], HITS + ", _pos int")
    first = Window.partitionBy("uid").orderBy("_pos", F.desc("score"))
    hits = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_pos")
    fused = traverse.cut(fuse(hits, semantic_search(nodes, encode, query, k, find=find), k))
    return fused, related(nodes, edges, fused, depth, callers, callees)
