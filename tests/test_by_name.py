"""Edges by names: right where nodes come in several rows, and not shuffled once they are made."""

from graphloom.operators import resolve

NODES = "uid string, label string, name string, base_classes array<string>"


def test_edges_of_nodes_with_one_name_are_not_shuffled_again(spark):
    nodes = spark.createDataFrame([("a", "Class", "A", ["B", "B"]), ("b", "Class", "B", None), ("b", "Class", "B", None)], NODES)
    found = resolve.inherits(nodes)
    assert [(r["src_uid"], r["dst_uid"]) for r in found.collect()] == [("a", "b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_a_node_of_several_names_is_met_once(spark):
    rows = [("a", "Class", "A", ["B", "C", None]), ("b", "Class", "B", None), ("b", "Class", "C", ["A", "B"]), ("c", "Class", None, ["C"]), ("d", "Class", "B", None)]
    found = sorted((r["src_uid"], r["dst_uid"]) for r in resolve.inherits(spark.createDataFrame(rows, NODES)).collect())
    assert found == [("a", "b"), ("a", "d"), ("b", "a"), ("b", "d"), ("c", "b")]
