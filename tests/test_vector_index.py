"""The vector index against a scan of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import search, vector_index
from graphloom.plans.store import Businesses
from graphloom.schema import EDGES, NODES, as_nodes

ROWS = "vec_id long, label string, embedding array<float>"


def clustered(n=6000, clusters=50, dim=24, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    # a third of all rows lies in one cluster
    own = np.where(rng.random(n) < 0.33, 0, rng.integers(clusters, size=n))
    return [(i, "AB"[i % 2] if i % 31 else None, [float(np.float32(x)) for x in v]) for i, v in enumerate(centres[own] + 0.1 * rng.normal(size=(n, dim)))]


ODD = [(-1, "A", None), (-2, "A", []), (-3, "B", [0.0] * 24), (-4, "A", [float("nan")] * 24), (-5, None, [1.0, None] + [0.0] * 22), (-6, "A", [1.0, 2.0]), (-7, "A", [float("inf")] + [0.0] * 23)]


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    made = clustered()
    rows = spark.createDataFrame(made + ODD + [(-8, "B", made[5][2]), (-9, "B", made[5][2])], ROWS).cache()
    return made, rows, vector_index.build(rows, str(tmp_path_factory.mktemp("index") / "v"), "vec_id")


def test_answers_equal_a_scan_and_most_rows_are_skipped(held):
    made, rows, index = held
    total, read = rows.count(), 0
    for i, k, labels in ((5, 10, ()), (6, 3, ("A",)), (7, 40, ("B", "A")), (40, 1, ())):
        want = search.vector_search(rows, made[i][2], k, labels, "vec_id").select("vec_id", "score").collect()
        assert index.nearest(made[i][2], k, labels).select("vec_id", "score").collect() == want and len(want) == k
        read += index.reach(made[i][2], k, labels).count()
    assert read / 4 < total / 2  # the share of rows scored, hot cluster and all labels included
    far = [-x for x in made[5][2]]
    assert index.nearest(far, 5).select("vec_id").collect() == search.vector_search(rows, far, 5, (), "vec_id").select("vec_id").collect()
    assert [r["vec_id"] for r in index.nearest([1.0, 2.0], 5).collect()] == [-6]
    for odd in ([0.0] * 24, [float("nan")] * 24, [1.0] * 5, []):
        assert index.nearest(odd, 5).count() == 0
    assert index.nearest(made[5][2], 5, ("none",)).count() == 0
    assert index.nearest(made[5][2], 10_000).count() == search.vector_search(rows, made[5][2], 10_000, (), "vec_id").count()


def test_ranges_reach_the_files(held):
    plan = held[2].reach(held[0][9][2], 2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(cell" in plan.replace(" ", "") and "angle" in plan.split("PushedFilters")[1]


def test_many_queries_equal_a_scan_and_meet_few_rows(spark, held):
    made, rows, index = held
    asked = spark.createDataFrame([(f"q{i}", made[i][2]) for i in range(0, 6000, 60)] + [("none", None), ("zero", [0.0] * 24), ("short", [2.0, 1.0])], "query_id string, vector array<double>")
    scored = spark.sparkContext.accumulator(0)
    near = lambda df: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())
    got = near(index.nearest_many(asked, 7, scored))
    assert got == near(search.vector_search_many(rows, asked, 7))
    assert 0 < scored.value < 100 * len(made) / 2


def test_nothing_to_index(spark, tmp_path):
    assert vector_index.build(spark.createDataFrame(ODD[:2], ROWS), str(tmp_path / "none"), "vec_id") is None
    index = vector_index.build(spark.createDataFrame(ODD[2:4], ROWS), str(tmp_path / "odd"), "vec_id")
    assert index is None or index.nearest([1.0] * 24, 3).count() == 0


def test_the_store_finds_by_index_what_a_scan_finds(spark, tmp_path):
    store = Businesses(spark, str(tmp_path)).store("t")
    nodes = as_nodes(spark.createDataFrame([(f"Function:{i}", "Function", v) for i, _, v in clustered(900, 12)], "uid string, label string, embedding array<float>"))
    none = spark.createDataFrame([], EDGES)
    store.write(nodes, none)
    vector = nodes.where("uid = 'Function:31'").first()["embedding"]

    def same():
        now = store.at()
        want = search.vector_search(now.nodes(), vector, 12).select(*NODES.fieldNames(), "score").collect()
        assert now.nearest(now.nodes(), vector, 12).select(*NODES.fieldNames(), "score").collect() == want
        return [r["uid"] for r in want]

    first = same()
    assert store.at().base["vectors"]
    store.upsert(as_nodes(nodes.where(F.col("uid").isin(first[:4])).select("uid", "label", F.transform("embedding", lambda x: -x).alias("embedding"))), none)
    store.upsert(as_nodes(spark.createDataFrame([("Class:new", "Class", vector)], "uid string, label string, embedding array<float>")), none)
    store.delete(F.col("uid") == first[5])
    second = same()
    assert "Class:new" in second and not set(first[:4] + [first[5]]) & set(second)
    store.compact()
    assert same() == second
