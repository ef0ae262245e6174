"""What `scan` makes is not merged with itself, texts are hashed in blocks, and a commit costs one join for each kind of thing that goes."""

from pyspark.sql import functions as F

from graphloom.operators import embed, mutate, resolve
from graphloom.plans.engine import Engine
from graphloom.plans.store import GraphStore
from graphloom.schema import EDGES, as_edges, as_nodes

A = "class A:\n  def f(self):\n    g()\n\ndef g():\n  pass\n"
B = "import a\nclass B(A):\n  pass\n"


def feed(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, status string, content string")


def test_sound_tables_are_not_merged_with_themselves(spark, tmp_path, monkeypatch):
    calls = []
    for name in ("upsert_nodes", "upsert_edges", "with_ends"):
        whole = getattr(mutate, name)
        monkeypatch.setattr(mutate, name, lambda *a, _n=name, _f=whole: calls.append(_n) or _f(*a))
    engine, given = Engine(GraphStore(spark, str(tmp_path / "a")), dim=8), []
    merged, ingest = GraphStore(spark, str(tmp_path / "b")), engine.store.ingest
    monkeypatch.setattr(engine.store, "ingest", lambda n, e, files=None, **how: given.append((n, e, files)) or ingest(n, e, files, **how))
    engine.apply(feed(spark, ("a.py", "A", A), ("b.py", "A", B), ("c.py", "A", A), ("c.py", "A", A)))
    engine.apply(feed(spark, ("b.py", "D", None), ("a.py", "M", "x = 1\n")))
    engine.apply(feed(spark, ("b.py", "A", B), ("a.py", "M", A + "def h():\n  g()\n")))
    assert calls == []
    for one in given:
        merged.ingest(*one)
    assert calls
    rows = lambda df, columns: sorted(map(str, df.select(*columns).collect()))
    assert rows(engine.store.nodes(), ("uid", "name", "signature", "embedding")) == rows(merged.nodes(), ("uid", "name", "signature", "embedding"))
    assert rows(engine.store.edges(), EDGES.fieldNames()) == rows(merged.edges(), EDGES.fieldNames())
    assert engine.store.edges().where("type in ('INHERITS', 'IMPORTS')").count() == 3


def test_blocks_of_texts_are_hashed_as_one_by_one(monkeypatch):
    texts = ["the cat theCat HTTPServer snake_case 12ab", "", None, "größe éA aB", "İst", "x" * 50, "aB c9D"] * 30
    want = [embed.hashed(t, 16) for t in texts]
    seen, block = [], embed._block
    monkeypatch.setattr(embed, "_CHARS", 100)
    monkeypatch.setattr(embed, "_block", lambda some, dim: seen.append(len(some)) or block(some, dim))
    assert embed.hashed_many(texts, 16).tolist() == want
    assert sum(seen) == len(texts) and 1 < len(seen) < len(texts)


def test_edges_come_and_go_and_come_again(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    name = lambda *ids: as_nodes(spark.createDataFrame([(f"Function:{i}", "Function", f"f{i}") for i in ids], "uid string, label string, name string"))
    link = lambda *ends: as_edges(spark.createDataFrame([(f"Function:{a}", f"Function:{b}", "CALLS") for a, b in ends], "src_uid string, dst_uid string, type string"))
    now = lambda: sorted((r["src_uid"][9:], r["dst_uid"][9:]) for r in store.edges().collect())
    store.write(name(1, 2, 3), link((1, 2), (2, 3), (3, 1)))
    store.upsert(name(4), link((1, 2), (3, 4)))
    assert now() == [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4")]
    joins = store.edges()._jdf.queryExecution().sparkPlan().toString().count("LeftAnti")
    assert joins == 1
    store.delete(F.col("name") == "f4")
    assert now() == [("1", "2"), ("2", "3"), ("3", "1")]
    store.upsert(name(4), link((4, 1), (3, 4)))
    assert now() == [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4"), ("4", "1")]
    store.delete(F.col("name") == "f1")
    assert now() == [("2", "3"), ("3", "4")] and store.nodes().count() == 3
    want = now()
    store.compact()
    assert now() == want


def test_names_of_a_node_are_there_once_without_a_shuffle(spark):
    rows = as_nodes(spark.createDataFrame([("m", "Module", "m", ["a.z", "b.z"])], "uid string, label string, name string, imports array<string>"))
    found = resolve.index(rows)
    assert sorted(tuple(r) for r in found.collect()) == [("m", "Module", "m"), ("z", "IMPORTS", "m")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
