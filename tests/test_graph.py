"""Graph operators against small graphs and brute force."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.operators import graph, intervals, mutate, resolve, search, traverse
from graphloom.plans.engine import Engine
from graphloom.plans.store import Businesses
from graphloom.schema import NODES, as_edges, as_nodes, uid
from graphloom.sources import changes, parse, scan
from graphloom.streaming import feed

PYTHON = '''"""Mod."""
import os
from pkg.util import helper

class Base:
    """Base doc."""
    def run(self):
        """Run it."""
        return helper()

class Child(Base):
    def go(self):
        self.run()
        inner()

def inner():
    return 1

def outer():
    inner()
    outer()
'''


def edges_frame(spark, pairs, kind="CALLS"):
    return as_edges(spark.createDataFrame([(a, b, kind) for a, b in pairs], "src_uid string, dst_uid string, type string"))


def nodes_frame(spark, names, label="Function"):
    return as_nodes(spark.createDataFrame([(n, label, n, "f", i) for i, n in enumerate(names)], "uid string, label string, name string, file string, start_line long"))


def simple_trails(pairs, start, depth):
    out, level = collections.Counter(), [(start, ())]
    for _ in range(depth):
        level = [(b, (*used, (a, b))) for at, used in level for a, b in pairs if a == at and (a, b) not in used]
        out.update(b for b, _ in level)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_trails_and_distances_match_brute_force(spark, seed):
    import random

    rnd = random.Random(seed)
    pairs = rnd.sample([(a, b) for a, b in itertools.product("abcde", repeat=2) if a != b], 7)
    edges, seeds = edges_frame(spark, pairs), spark.createDataFrame([("a",)], "uid string")
    got = collections.Counter(r["uid"] for r in traverse.trails(seeds, edges, 10).collect())
    assert got == simple_trails(pairs, "a", 10)
    dist, frontier = {"a": 0}, ["a"]
    for d in range(1, 4):
        frontier = [b for x in frontier for a, b in pairs if a == x and b not in dist and not dist.update({b: d})]
    assert {r["uid"]: r["dist"] for r in traverse.distances(seeds, edges, 3).collect()} == dist
    reach = {(a, b) for a, b in pairs if dist.get(a, 9) < 3}
    assert {(r["src_uid"], r["dst_uid"]) for r in traverse.path_edges(seeds, edges, 3).collect()} == reach


@pytest.mark.parametrize("depth", [3, 4, 6])
def test_trail_counts_on_loops_and_diamonds(spark, depth):
    # a cycle whose first edge alone comes round again within the depth, a loop of one node, and diamonds before both
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("a", "e"), ("d", "f"), ("e", "f"), ("f", "f"), ("f", "g")]
    rows = traverse.trail_counts(spark.createDataFrame([("a",)], "uid string"), edges_frame(spark, pairs), depth).collect()
    got = collections.Counter()
    for r in rows:
        got[r["uid"]] += r["n"]
    assert got == simple_trails(pairs, "a", depth)


def test_many_diamonds_take_a_row_for_each_node(spark):
    pairs = [(f"n{k}", f"{x}{k}") for k in range(12) for x in "lr"] + [(f"{x}{k}", f"n{k + 1}") for k in range(12) for x in "lr"]
    rows = traverse.trail_counts(spark.createDataFrame([("n0",)], "uid string"), edges_frame(spark, pairs), 10).collect()
    assert len(rows) == 15 and {r["uid"]: r["n"] for r in rows}["n5"] == 32


def test_traversals_of_empty_graphs(spark):
    nodes, edges = nodes_frame(spark, ["a"]).limit(0), edges_frame(spark, [("a", "b")]).limit(0)
    assert graph.call_chain(nodes, edges, "a").count() == 0
    assert graph.inheritance_tree(nodes, edges, "a").count() == 0
    assert graph.explore(nodes, edges, "a")[0].count() == 0
    assert {r["n"] for r in graph.graph_stats(nodes, edges).collect()} == {0}


def test_diamond_counts_each_trail(spark):
    nodes = nodes_frame(spark, "abcd", "Class")
    edges = edges_frame(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "INHERITS")
    names = [r["name"] for r in graph.inheritance_tree(nodes, edges, "a", "parents").collect()]
    assert sorted(names) == ["b", "c", "d", "d"]
    assert sorted(r["name"] for r in graph.inheritance_tree(nodes, edges, "a", "parents", distinct=True).collect()) == ["b", "c", "d"]


def test_explore_keeps_an_isolated_centre(spark):
    shown, links = graph.explore(nodes_frame(spark, ["a", "b"]), edges_frame(spark, [("b", "b")]), "a")
    assert [(r["uid"], r["center"]) for r in shown.select("uid", "center").collect()] == [("a", True)]
    assert links.count() == 0


def test_resolve_fans_out_to_namesakes_and_skips_self(spark):
    rows = [("1", "Class", "A", ["B", "A"]), ("2", "Class", "B", None), ("3", "Class", "B", [])]
    nodes = as_nodes(spark.createDataFrame(rows, "uid string, label string, name string, base_classes array<string>"))
    assert {(r["src_uid"], r["dst_uid"]) for r in resolve.inherits(nodes).collect()} == {("1", "2"), ("1", "3")}


def test_innermost_range_takes_the_first_of_equal_ones(spark):
    ranges = spark.createDataFrame([("k", 1, 9, "out", 0), ("k", 3, 5, "x", 1), ("k", 4, 6, "y", 2)], "key string, start_line int, end_line int, name string, pos int")
    points = spark.createDataFrame([("k", 4), ("k", 6), ("k", 99), ("other", 4)], "key string, line int")
    got = {(r["key"], r["line"]): r["inside"] for r in intervals.innermost(points, ranges, "key", "line").collect()}
    assert got == {("k", 4): "x", ("k", 6): "y", ("k", 99): None, ("other", 4): None}


def test_upsert_keeps_what_is_not_given(spark):
    old = as_nodes(spark.createDataFrame([("u", "Function", "n", "s")], "uid string, label string, name string, signature string"))
    new = spark.createDataFrame([("u", "Function", "t"), ("v", "Class", "w")], "uid string, label string, signature string")
    got = {r["uid"]: (r["name"], r["signature"]) for r in mutate.upsert_nodes(old, new).collect()}
    assert got == {"u": ("n", "t"), "v": (None, "w")}


def test_upsert_edges_needs_both_ends(spark):
    nodes = nodes_frame(spark, "ab")
    got = mutate.upsert_edges(edges_frame(spark, [("a", "b")]), edges_frame(spark, [("a", "b"), ("b", "a"), ("a", "z")]), nodes)
    assert {(r["src_uid"], r["dst_uid"]) for r in got.collect()} == {("a", "b"), ("b", "a")} and got.count() == 2


def test_keyword_tiers(spark):
    rows = [("1", "Function", "load", "a.b.C#load"), ("2", "Function", "LoadAll", None), ("3", "Document", "load", None), ("4", "Class", "C", None)]
    nodes = as_nodes(spark.createDataFrame(rows, "uid string, label string, name string, fqn string"))
    edges = edges_frame(spark, [("4", "2")], "CONTAINS")
    find = lambda word, **k: [(r["uid"], r["score"]) for r in search.keyword_search(nodes, edges, word, **k).collect()]
    assert find("load") == [("1", 1.0), ("2", 0.9)]
    assert find("load", exact_only=True) == [("1", 1.0)]
    assert find("a.b.C#load") == [("1", 1.0)]
    assert find("x.C#LoadAll(int)") == [("2", 0.95)]
    assert find("nothing") == []


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first()["x"]

    assert one(X.identifiers(F.lit("where does getUserInfo call load_all and MyClass"))) == ["getUserInfo", "call", "load_all", "MyClass"]
    assert one(X.identifiers(F.lit(None).cast("string"))) == []
    assert one(X.qualified_name(F.lit("see com.acme.Svc#run(int) now"))) == "com.acme.Svc#run"
    assert one(X.qualified_name(F.lit("a.b is short"))) == ""
    assert one(X.language(F.lit("a/b.TSX"))) == "typescript" and one(X.language(F.lit("a.csv"))) is None
    assert one(X.stem(F.lit("a/b.tar.gz"))) == "b.tar"
    assert one(X.code_references(F.lit("`ab` `abc` `x.y.long` \n```\n`fence`\n```"))) == ["abc", "long"]
    assert one(X.truncated(F.lit("abcdef"), 3, "+")) == "abc+"
    assert one(uid(F.lit("Module"), F.lit(None).cast("string"), F.lit("n"), F.lit(None).cast("int"))) == "Module::n:0"


def test_markdown_and_rst_sections(spark):
    docs = spark.createDataFrame([("a.md", "intro\n# One\ntext\n```\n# fenced\n```\n### Three"), ("b.md", ""), ("c.md", None)], "path string, content string")
    got = [(r["title"], r["level"], r["start_line"], r["body"]) for r in X.sections(docs).orderBy("path", "pos").collect()]
    assert got == [("One", 1, 2, "text\n```"), ("fenced", 1, 5, "```"), ("Three", 3, 7, "")]
    rst = spark.createDataFrame([("a.rst", "Title\n=====\nbody\nSub\n---\nmore\nshort\n--")], "path string, content string")
    assert [(r["title"], r["level"], r["body"]) for r in X.sections(rst, "rst").orderBy("pos").collect()] == [("Title", 1, "body"), ("Sub", 2, "more\nshort\n--")]


def test_parse_python():
    rows = parse.parse("python", PYTHON)
    functions = {r[2]: r for r in rows if r[0] == "function"}
    assert functions["run"][8] == "Base" and functions["run"][6] == "Run it." and functions["inner"][8] is None
    assert [r[9] for r in rows if r[0] == "class"] == [[], ["Base"]]
    assert [r[2] for r in rows if r[0] == "import"] == ["os", "pkg.util"]
    assert ("inner", "outer") in {(r[2], r[8]) for r in rows if r[0] == "call"}
    assert parse.parse("python", "def broken(") == [] and parse.parse("ruby", "x") == [] and parse.parse("python", None) == []


def test_long_bodies_are_cut():
    body = "def f():\n" + "\n".join(f"    x{i} = {i}" for i in range(500))
    assert len(next(r for r in parse.parse("python", body) if r[0] == "function")[7]) <= 2020


@pytest.mark.parametrize(
    ("language", "source", "functions", "classes"),
    [
        ("java", "class A extends B<T> {\n  A() { }\n  int f(int x) { return g(x); }\n  int g(int x) { return 1; }\n}", ["f", "g"], [("A", ["B<T>"])]),
        ("go", "package m\ntype S struct {}\nfunc A() { B() }\nfunc B() {}\n", ["A", "B"], [("S", [])]),
        ("javascript", "function f() { g(); }\nclass K extends Q { m() { f(1); } }\nfunction g() {}", ["f", "m", "g"], [("K", ["Q"])]),
        ("typescript", "export function f(a: number): void { }\n", ["f"], []),
    ],
)
def test_parse_braced(language, source, functions, classes):
    rows = parse.parse(language, source)
    assert sorted(r[2] for r in rows if r[0] == "function") == sorted(functions)
    assert [(r[2], r[9]) for r in rows if r[0] == "class"] == classes


def test_document_root_and_first_section_share_a_node(spark):
    docs = scan.payload(spark, [("README.md", "# T\nsee `name_x`\n## U\nmore")])
    nodes, edges = scan.document_graph(docs)
    rows = {r["uid"]: r for r in nodes.collect()}
    assert set(rows) == {"Document:README.md:T:1", "Document:README.md:U:3"}
    assert rows["Document:README.md:T:1"]["title"] == "T > T" and rows["Document:README.md:T:1"]["code_references"] == ["name_x"]
    assert ("Document:README.md:T:1", "Document:README.md:T:1") in {(r["src_uid"], r["dst_uid"]) for r in edges.collect()}


def test_git_differences():
    assert changes.parse_diff("A\ta.py\nM\tb.py\nR100\told.py\tnew.py\nD\tc.py\n") == [("a.py", "A"), ("b.py", "M"), ("old.py", "D"), ("new.py", "A"), ("c.py", "D")]


def test_engine_from_files_to_answers(spark, tmp_path):
    tenants = Businesses(spark, str(tmp_path / "root"))
    store = tenants.create("demo")
    with pytest.raises(ValueError):
        tenants.create("demo")
    with pytest.raises(ValueError):
        tenants.create("No Good")
    engine = Engine(store, dim=32)
    folder = tmp_path / "repo"
    (folder / "node_modules").mkdir(parents=True)
    (folder / "m.py").write_text(PYTHON)
    (folder / "node_modules" / "no.py").write_text("def no(): pass")
    (folder / "README.md").write_text("# Guide\nintro `Base`\n")
    engine.index_full(str(folder), "r1")
    stats = {r["name"]: r["n"] for r in engine.ask("graph_stats").collect()}
    assert (stats["Function"], stats["Class"], stats["Module"], stats["CALLS"], stats["INHERITS"], stats["REFERENCES"]) == (4, 2, 1, 3, 1, 1)
    assert engine.ask("call_chain", name="outer").first()["target_name"] == "inner"
    assert engine.sql("select count(*) c from class where name = :n", {"n": "Base"}).first()["c"] == 1
    with pytest.raises(ValueError):
        engine.sql("drop table nodes")
    with pytest.raises(ValueError):
        engine.ask("nonsense")
    hits, context = engine.hybrid("what does inner do")
    assert hits.first()["name"] == "inner" and context.count() > 0
    before = sorted(r["uid"] for r in store.nodes().collect())
    engine.index_files([("m.py", PYTHON)], "r1")
    assert sorted(r["uid"] for r in store.nodes().collect()) == before

    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "1.json").write_text('{"path": "m.py", "status": "D", "seq": 2}\n{"path": "n.py", "status": "A", "content": "def late(): pass", "seq": 1}\n')
    feed.apply(feed.read(spark, str(inbox)), engine, str(tmp_path / "cp")).awaitTermination(120)
    names = {r["name"] for r in store.nodes().collect()}
    assert "late" in names and "outer" not in names
    assert store.delete_repository("r1") > 0
    tenants.delete("demo")
    assert tenants.list().count() == 0


def test_schema_of_empty_store(spark, tmp_path):
    store = Businesses(spark, str(tmp_path)).store("none")
    assert store.nodes().schema == NODES and store.edges().count() == 0


def test_sql_is_read_only(spark, tmp_path):
    engine = Engine(Businesses(spark, str(tmp_path / "kb")).ensure_default())
    assert engine.sql("with x as (select 1 as a) select a from x").first()["a"] == 1
    assert engine.sql("from nodes select count(*) as n").first()["n"] == 0
    assert engine.sql("select count(*) as n from nodes where uid in (select src_uid from edges where type = :t)", {"t": "CALLS"}).first()["n"] == 0
    out = tmp_path / "out"
    for text in (
        "", "  \n", "selec", f"FROM nodes INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT uid",
        f"WITH q AS (SELECT 1 AS a) INSERT OVERWRITE DIRECTORY '{out}' USING parquet SELECT a FROM q", "DROP VIEW nodes", "SET x = 1",
        "create table t as select 1 as a", "select reflect('java.lang.System', 'getProperty', 'user.home')", "with a as (select java_method('java.lang.Math', 'abs', 1)) select * from a",
    ):
        with pytest.raises(ValueError):
            engine.sql(text)
    assert not out.exists()


def test_answers_outlive_writes(spark, tmp_path):
    engine = Engine(Businesses(spark, str(tmp_path / "kb")).ensure_default())
    stats = engine.index_files([("a.py", "def f():\n    g()\n\ndef g():\n    pass\n")], "r")
    assert stats["function"] == 2 and stats["files"] >= 1
    answer = engine.ask("find_entity", name="f")
    engine.index_files([("b.py", "def h():\n    pass\n")])
    assert answer.count() == 1
    assert engine.store.vacuum() == 1 and engine.ask("find_entity", name="h").count() == 1
    assert [r["name"] for r in engine.keyword("h").collect()] == ["h"]
    for wrong in ({"direction": "sideways"}, {"entity_type": "functions"}, {"depth": 0}):
        with pytest.raises(ValueError):
            engine.ask("call_chain", name="f", **wrong)


def test_prefix_goes_at_the_start_only(spark):
    nodes = as_nodes(spark.createDataFrame([("Function:/r/a.py:x:/r/", "Function", "/r/a.py"), ("Function:b.py:y:/r/", "Function", "b.py")], "uid string, label string, file string"))
    edges = as_edges(spark.createDataFrame([("CALLS", "Function:/r/a.py:x:/r/", "Function:b.py:y:/r/")], "type string, src_uid string, dst_uid string"))
    moved, linked = mutate.strip_prefix(nodes, edges, "/r/")
    assert {r["uid"] for r in moved.collect()} == {"Function:a.py:x:/r/", "Function:b.py:y:/r/"}
    assert [tuple(r) for r in linked.select("src_uid", "dst_uid").collect()] == [("Function:a.py:x:/r/", "Function:b.py:y:/r/")]


def test_vectors_of_many_queries(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 8)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(200)] + [(900, None), (901, [0.0] * 6), (902, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = search.vector_search_many(df, df.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 4)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:200] if np.any(v)}
    expected = {(q, r + 1, v) for q in unit if q < 30 for r, (_, v) in enumerate(sorted((-round(float(unit[q] @ w), 9), i) for i, w in unit.items())[:4])}
    found = {(r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()}
    assert len(found & expected) >= 0.97 * len(expected) and len(found) == len(expected)
