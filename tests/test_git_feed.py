"""Commits as a data source, in batches and as a stream."""

import pytest
from pyspark.errors import PySparkException

from graphloom.plans.engine import Engine
from graphloom.plans.store import Businesses
from graphloom.sources import git_feed
from graphloom.streaming import feed

from test_changes import commit, git  # isort: skip

FIRST = {"a.py": "from b import g\nclass A: pass\ndef f():\n    g()\n", "b.py": "def g(): pass\n", "README.md": "# Top\nsee `some_name`\n", "x.bin": "1"}
SECOND = {"a.py": "class A(B): pass\n", "c/é d.py": "class B: pass\n", "b.py": None}
THIRD = {"README.md": "# Top\nsee `some_name`\n## More\ntext\n", "c/é d.py": "class B: pass\ndef some_name(): pass\n", "vendor/v.py": "def v(): pass\n"}


@pytest.fixture
def origin(tmp_path):
    folder = tmp_path / "origin"
    folder.mkdir()
    git(folder, "init", "-q")
    commit(folder, FIRST)
    return folder


def graph(engine):
    nodes, edges = engine.store.snapshot()
    return {(r["uid"], r["content_hash"], r["code_snippet"]) for r in nodes.collect()}, {(r["src_uid"], r["dst_uid"], r["type"], r["line"]) for r in edges.collect()}


def test_differences_of_two_commits(spark, origin):
    commit(origin, SECOND)
    rows = {(r["path"], r["status"], r["content"]) for r in git_feed.load(spark, str(origin), "HEAD~1").collect()}
    assert rows == {("a.py", "M", SECOND["a.py"]), ("c/é d.py", "A", SECOND["c/é d.py"]), ("b.py", "D", None)}
    whole = git_feed.load(spark, str(origin))
    assert {r["path"] for r in whole.collect()} == {"a.py", "c/é d.py", "README.md", "x.bin"}
    assert git_feed.load(spark, str(origin), "HEAD", "HEAD").count() == 0
    parts = git_feed.split(str(origin), git_feed.NOTHING, "HEAD", 2)
    assert [len(p.files) for p in parts] == [2, 2] and sum(len(list(git_feed.read(p))) for p in parts) == 4
    with pytest.raises(PySparkException):
        git_feed.load(spark, str(origin), "no such commit").count()


def test_a_stream_of_commits_gives_the_graph_of_a_full_index(spark, origin, tmp_path):
    tenants = Businesses(spark, str(tmp_path / "kb"))
    engine = Engine(tenants.create("streamed"), dim=8)

    def step():
        feed.apply(feed.commits(spark, str(origin)), engine, str(tmp_path / "checkpoint")).awaitTermination(240)
        return engine.store.version()

    versions = [step()]
    for files in (SECOND, THIRD):
        commit(origin, files)
        versions.append(step())
    assert versions == sorted(set(versions))
    assert step() == versions[-1]  # started again from its checkpoint: nothing is applied twice
    whole = Engine(tenants.create("whole"), dim=8)
    whole.index_full(str(origin))
    assert graph(engine) == graph(whole)
    assert ("Class:a.py:A:1", "Class:c/é d.py:B:1", "INHERITS", None) in graph(engine)[1]
