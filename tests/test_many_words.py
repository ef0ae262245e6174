"""Many keywords at once: popular names and words make no more rows than the answer needs, and no word meets all names."""

import random

from graphloom.operators import search
from graphloom.schema import as_edges, as_nodes

WORDS = "query_id long, pos int, word string"


def _nodes(spark, names):
    return as_nodes(spark.createDataFrame([(f"n{i:04}", "Function", x, f"a.b.{x}") for i, x in enumerate(names)], "uid string, label string, name string, fqn string"))


def test_popular_names_are_cut_before_words_meet_them(spark):
    nodes = _nodes(spark, ["red ring"] * 50 + ["blue"] * 5)
    code = nodes.select("name", "uid", "label", "file", "start_line", "fqn")
    asked = spark.createDataFrame([("red",)], "word string")
    assert search._names_of_words(code, asked, 3).count() == 3
    words = spark.createDataFrame([(q, 1, w) for q, w in enumerate(["red"] * 20 + ["a.b.blue"] * 20)], WORDS)
    found = search.keyword_search_many(nodes, words, 3).collect()
    assert {(r["query_id"], r["rank"]): r["uid"] for r in found} == {(q, k): f"n{k - 1 if q < 20 else 49 + k:04}" for q in range(40) for k in (1, 2, 3)}


def test_words_meet_names_as_by_brute_force(spark):
    rng = random.Random(3)
    names = ["".join(rng.choice("abAB_") for _ in range(rng.randrange(1, 7))) for _ in range(300)] + ["İİ", "İx", None]
    asked = ["".join(rng.choice("abA_") for _ in range(rng.randrange(0, 5))) for _ in range(60)] + ["i̇i", "zzz", "ab", "İ"]
    words = spark.createDataFrame([(q, 1, w) for q, w in enumerate(asked)], WORDS)
    found = {}
    for r in search.keyword_search_many(_nodes(spark, names), words, 4).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["uid"], r["tier"])
    for q, w in enumerate(asked):
        hits = [((x != w), len(x) if x != w else 0, f"n{i:04}", 1.0 if x == w else 0.9) for i, x in enumerate(names) if x is not None and w.lower() in x.lower()]
        assert [found.get(q, {}).get(k + 1) for k in range(4) if k < len(hits)] == [h[2:] for h in sorted(hits)[:4]], w


def test_a_word_reads_its_rarest_list_alone(spark):
    names = [f"aaa{i}" for i in range(40)] + ["aaaxyz"]
    code = _nodes(spark, names).select("name", "label")
    words = spark.createDataFrame([("AAAX",), ("aaaq",)], "word string")
    assert [tuple(r) for r in search._holding(code, words).collect()] == [("aaaxyz", "AAAX")]


def test_methods_of_many_words(spark):
    rows = [("c1", "Class", "K"), ("c2", "Class", "K"), ("m1", "Function", "go"), ("m2", "Function", "go"), ("m3", "Function", "stop")]
    nodes = as_nodes(spark.createDataFrame(rows, "uid string, label string, name string"))
    edges = as_edges(spark.createDataFrame([("c1", "m1", "CONTAINS"), ("c2", "m2", "CONTAINS"), ("c1", "m3", "CONTAINS")], "src_uid string, dst_uid string, type string"))
    words = spark.createDataFrame([(1, 1, "x.K#go(int)"), (2, 1, "K#go"), (3, 1, "K#stop"), (4, 1, "K#none")], WORDS)
    found = search.keyword_search_many(nodes, words, 5, edges).collect()
    assert sorted((r["query_id"], r["rank"], r["uid"], r["tier"]) for r in found) == [(1, 1, "m1", 0.95), (1, 2, "m2", 0.95), (2, 1, "m1", 0.95), (2, 2, "m2", 0.95), (3, 1, "m3", 0.95)]
