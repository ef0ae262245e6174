"""What Spark takes for small by the bytes of its files is not sent to all tasks whole, and wide rows are sorted after they are dealt out."""

from pyspark.sql import functions as F

from graphloom.operators import mutate, resolve, traverse
from graphloom.plans import store as stores
from graphloom.plans.store import GraphStore
from graphloom.schema import EDGES, as_edges, as_nodes


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def chain(spark, n):
    nodes = as_nodes(spark.range(n).select(F.concat(F.lit("Function:"), "id").alias("uid"), F.lit("Function").alias("label"), F.concat(F.lit("f"), "id").alias("name")))
    edges = as_edges(spark.range(n).select(F.concat(F.lit("Function:"), "id").alias("src_uid"), F.concat(F.lit("Function:"), F.col("id") + 1).alias("dst_uid"), F.lit("CALLS").alias("type")))
    return nodes, edges


def test_ends_are_looked_up_without_sending_all_nodes_to_all_tasks(spark):
    nodes, edges = (traverse.cut(x) for x in chain(spark, 50))
    for found in (mutate.with_ends(edges, nodes), mutate.upsert_edges(edges.limit(0), edges, nodes)):
        assert "BroadcastHashJoin" not in plan(found) and "SortMergeJoin" in plan(found)
        assert found.count() == 49


def test_many_changed_rows_are_shuffled_and_few_are_sent(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path))
    nodes, edges = chain(spark, 50)
    store.upsert(nodes, edges)
    store.delete(F.col("name") == "f7")
    few = plan(store.nodes()), plan(store.edges())
    monkeypatch.setattr(stores, "SMALL", 0)
    assert all("BroadcastHashJoin" in x for x in few)
    assert not any("BroadcastHashJoin" in plan(x) for x in (store.nodes(), store.edges(), store.at().names()))
    assert store.nodes().count() == 49 and store.edges().count() == 47


def test_sized_tables_are_sent_or_shuffled(spark):
    nodes = traverse.cut(chain(spark, 50)[0])
    join = lambda most: plan(nodes.join(traverse.sized(nodes.select("uid"), most), "uid", "left_semi"))
    assert "BroadcastHashJoin" in join(50) and "BroadcastHashJoin" not in join(49)


def test_wide_rows_are_dealt_out_before_they_are_sorted(spark):
    nodes = traverse.cut(chain(spark, 50)[0])
    merged = mutate.upsert_nodes(spark.createDataFrame([], nodes.schema), nodes)
    text = merged._jdf.queryExecution().executedPlan().toString()
    own = text[: text.rindex("FileScan")]
    assert own.rindex("Exchange") > own.rindex("SortAggregate")  # the scan goes into the exchange, and no sort lies between them
    assert merged.count() == 50


def test_supports_are_counted_once_for_added_and_removed_edges(spark):
    rows = as_nodes(spark.createDataFrame([("Class:a", "Class", "A", ["B"]), ("Class:b", "Class", "B", None)], "uid string, label string, name string, base_classes array<string>"))
    none = spark.createDataFrame([], rows.schema)
    added, removed = resolve.delta(none, rows, rows.select("uid"), resolve.index(none))
    assert len({tuple(sorted(x.inputFiles())) for x in (added, removed)}) == 1 and added.inputFiles()
    assert [tuple(r) for r in added.collect()] == [("Class:a", "Class:b", "INHERITS", None)] and removed.count() == 0
    gone = resolve.delta(rows, none, rows.select("uid"), resolve.index(rows))
    assert gone[0].count() == 0 and gone[1].count() == 1
    assert gone[1].columns == EDGES.fieldNames()


def test_names_are_taken_from_nodes_in_one_pass(spark):
    kind = "uid string, label string, name string, file string, path string, fqn string, base_classes array<string>, imports array<string>, code_references array<string>"
    rows = [
        ("c", "Class", "C", "f", None, "a.C", ["B", None, "B"], ["no"], ["no"]), ("m", "Module", "m", None, "p", None, ["no"], ["x.y.z", "z", None], None), ("d", "Document", "d", "g", "p", None, None, None, ["C", "f"]),
        ("f", "Function", None, "f", None, None, [], [], None), ("n", None, "n", None, None, None, ["no"], ["no"], ["no"]),
    ]
    found = resolve.index(as_nodes(spark.createDataFrame(rows, kind)))
    want = [("C", "Class", "c"), ("f", "FILE", "c"), ("a.C", "FQN", "c"), ("B", "INHERITS", "c"), ("m", "Module", "m"), ("p", "FILE", "m"), ("z", "IMPORTS", "m"), ("g", "FILE", "d"), ("C", "REFERENCES", "d"), ("f", "REFERENCES", "d"), ("f", "FILE", "f")]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "Union" not in plan(found)


def test_names_and_letters_are_taken_from_the_nodes_as_written(spark, tmp_path, monkeypatch):
    store = GraphStore(spark, str(tmp_path))
    store.upsert(*chain(spark, 20))
    store.delete(F.col("name") == "f7")
    seen, index, grams = [], resolve.index, resolve.grams
    monkeypatch.setattr(resolve, "index", lambda nodes: seen.append(nodes) or index(nodes))
    monkeypatch.setattr(resolve, "grams", lambda nodes: seen.append(nodes) or grams(nodes))
    want = {tuple(r) for r in store.at().names().collect()}
    seen.clear()
    store.compact()
    assert len(seen) == 2 and not any("Join" in plan(x) for x in seen)
    assert {tuple(r) for r in store.at().names().collect()} == want and store.nodes().count() == 19
