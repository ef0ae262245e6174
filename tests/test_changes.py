"""Change feeds of real git copies, and changes of a store that no query shows."""

import subprocess

import pytest
from pyspark.sql import functions as F

from graphloom.plans.engine import Engine
from graphloom.plans.store import Businesses
from graphloom.schema import as_edges, as_nodes
from graphloom.sources import changes, scan


def git(folder, *args):
    who = ["-c", "user.name=t", "-c", "user.email=t@example.org", "-c", "init.defaultBranch=main"]
    return subprocess.run(["git", *who, "-C", str(folder), *args], check=True, capture_output=True, text=True).stdout


def commit(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.unlink() if text is None else path.write_text(text)
    git(folder, "add", "-A")
    git(folder, "commit", "-q", "-m", "x")


@pytest.fixture
def copies(tmp_path):
    """A repository and a clone of it, one commit behind."""
    origin, clone = tmp_path / "origin", tmp_path / "clone"
    origin.mkdir()
    git(origin, "init", "-q")
    commit(origin, {"a.py": "def old(): pass\n", "gone.py": "def gone(): pass\n", "keep.py": "def keep(): pass\n", "README.md": "# Top\nsee `keep`\n", "x.csv": "1"})
    git(tmp_path, "clone", "-q", str(origin), str(clone))
    commit(origin, {"a.py": "def fresh(): pass\n", "gone.py": None, "new [1]{b}.py": "class New: pass\n", "docs/g.md": "# Guide\nsee `New`\n", "vendor/v.py": "def v(): pass\n", "x.csv": "2"})
    return origin, clone


def test_changes_of_a_git_copy(spark, copies):
    origin, _ = copies
    code = {(r["path"], r["status"]) for r in changes.git_changes(spark, str(origin)).collect()}
    assert code == {("a.py", "M"), ("gone.py", "D"), ("new [1]{b}.py", "A")}
    docs = {(r["path"], r["status"]) for r in changes.git_changes(spark, str(origin), documents=True).collect()}
    assert docs == {("docs/g.md", "A")}
    assert changes.git_changes(spark, str(origin), "HEAD", "HEAD").count() == 0


def test_named_files_are_read_alone(spark, copies):
    origin, _ = copies
    rows = {r["path"]: r["content"] for r in scan.named_files(spark, str(origin), ["a.py", "new [1]{b}.py", "docs/g.md", "gone.py"]).collect()}
    assert rows == {"a.py": "def fresh(): pass\n", "new [1]{b}.py": "class New: pass\n", "docs/g.md": "# Guide\nsee `New`\n"}
    assert scan.named_files(spark, str(origin), []).count() == 0 and scan.named_files(spark, str(origin), ["none.py"]).count() == 0


def test_sync_brings_a_store_to_the_new_commit(spark, copies, tmp_path):
    origin, clone = copies
    tenants = Businesses(spark, str(tmp_path / "kb"))
    engine = Engine(tenants.ensure_default(), dim=16)
    engine.index_full(str(clone))
    got = engine.sync_all({"r": str(clone), "absent": str(tmp_path / "absent")})
    assert got["r"] == {"added": 2, "modified": 1, "deleted": 1} and isinstance(got["absent"], str)
    assert engine.sync(str(clone), "r") is None
    shown = engine.document("Document:docs/g.md:Guide:1", str(clone)).collect()
    assert [(r["title"], r["content"], r["level"]) for r in shown] == [("Guide", "see `New`", 1)]
    nodes, edges = engine.store.snapshot()
    known = {(r["label"], r["name"]) for r in nodes.select("label", "name").collect()}
    assert {("Function", "fresh"), ("Function", "keep"), ("Class", "New"), ("Document", "Guide")} <= known
    assert not {("Function", "old"), ("Function", "gone"), ("Function", "v")} & known
    # the same as if the new commit had been indexed at once
    other = Engine(tenants.create("other"), dim=16)
    other.index_full(str(origin))
    n, e = other.store.snapshot()
    assert {r["uid"] for r in n.collect()} == {r["uid"] for r in nodes.collect()}
    assert {tuple(r) for r in e.collect()} == {tuple(r) for r in edges.collect()}
    assert nodes.where("repository = 'r'").count() == nodes.where("file is not null").count()


def test_changes_of_a_store(spark, tmp_path):
    tenants = Businesses(spark, str(tmp_path))
    first = tenants.ensure_default()
    rows = [
        ("Class:/w/r/src/main/java/a/K.java:K:1", "Class", "K", "/w/r/src/main/java/a/K.java", 1),
        ("Function:/w/r/src/main/java/a/K.java:m:2", "Function", "m", "/w/r/src/main/java/a/K.java", 2),
        ("Function:vendor/x.py:v:1", "Function", "v", "vendor/x.py", 1),
    ]
    nodes = as_nodes(spark.createDataFrame(rows, "uid string, label string, name string, file string, start_line long"))
    nodes = nodes.withColumn("repository", F.when(F.col("file").startswith("/w"), "r"))
    edges = as_edges(spark.createDataFrame([(rows[0][0], rows[1][0], "CONTAINS"), (rows[0][0], "nowhere", "CALLS")], "src_uid string, dst_uid string, type string"))
    assert first.upsert(nodes, edges) == {"nodes": 3, "edges": 1}
    assert first.upsert(nodes.where("label = 'Class'"), edges) == {"nodes": 1, "edges": 1}
    assert (first.nodes().count(), first.edges().count()) == (3, 1)
    assert first.backfill_fqn() == 2 and {r["fqn"] for r in first.nodes().collect()} == {"a.K", "a.K#m", None}
    first.tag("s")
    assert {r["repository"] for r in first.nodes().collect()} == {"r", "s"}
    assert first.migrate_paths("r") == 2 and first.migrate_paths("r") == 0
    assert {r["uid"] for r in first.nodes().collect()} == {"Class:src/main/java/a/K.java:K:1", "Function:src/main/java/a/K.java:m:2", "Function:vendor/x.py:v:1"}
    assert first.edges().first()["dst_uid"] == "Function:src/main/java/a/K.java:m:2"
    first.set_fqn("Function:vendor/x.py:v:1", "q")
    assert first.nodes().where("fqn = 'q'").count() == 1
    assert first.cleanup_excluded() == 1 and first.delete_file("src/main/java/a/K.java") == 2 and first.delete_file("absent") == 0
    assert (first.nodes().count(), first.edges().count()) == (0, 0)


def test_tenants(spark, tmp_path):
    tenants = Businesses(spark, str(tmp_path))
    for name in ("default", "b2", "a1"):
        tenants.create(name, name.upper(), f"the {name}")
    assert [r["id"] for r in tenants.list().collect()] == ["default", "b2", "a1"]
    assert tenants.get("b2").first()["description"] == "the b2" and tenants.get("none").count() == 0
    tenants.delete("b2")
    assert [r["id"] for r in tenants.list().collect()] == ["default", "a1"]
    with pytest.raises(ValueError):
        tenants.delete("default")
