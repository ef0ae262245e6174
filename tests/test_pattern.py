"""Path patterns against enumeration by hand."""

import itertools
import random

import pytest

from graphloom.operators.pattern import BOTH, IN, Edge, Node, match
from graphloom.schema import as_edges, as_nodes


def some_graph(spark, seed, n=9, m=22):
    rnd = random.Random(seed)
    nodes = [(f"u{i}", rnd.choice("FC"), f"n{i % 4}") for i in range(n)]
    edges = [(f"u{rnd.randrange(n)}", f"u{rnd.randrange(n)}", rnd.choice("XY"), rnd.choice((None, 1, 2))) for _ in range(m)]
    return nodes, edges, as_nodes(spark.createDataFrame(nodes, "uid string, label string, name string")), as_edges(spark.createDataFrame(edges, "src_uid string, dst_uid string, type string, line long"))


def joined(edges, edge):
    """Pairs that an edge pattern joins."""
    one = {(s, d) for s, d, t, _ in edges if not edge.types or t in edge.types}
    one = {OUT: one, IN: {(d, s) for s, d in one}, BOTH: one | {(d, s) for s, d in one}}[edge.direction]
    ends = {x for e in edges for x in e[:2]}
    level, out = {(x, x) for x in ends}, set()
    for k in range(edge.most + 1):
        if k >= edge.least:
            out |= level
        level = {(a, d) for a, b in level for c, d in one if b == c}
    return out


OUT = "out"


def by_hand(nodes, edges, fits, paths):
    names = list(dict.fromkeys(n for p in paths for n in p[::2]))
    pairs = [(p[k], joined(edges, p[k + 1]), p[k + 2]) for p in paths for k in range(0, len(p) - 2, 2)]
    out = set()
    for pick in itertools.product(*([u for u, lab, name in nodes if fits[n](lab, name)] for n in names)):
        at = dict(zip(names, pick, strict=True))
        if all((at[a], at[b]) in held or (a == b and at[a] == at[b] and (at[a], at[a]) in held) for a, held, b in pairs):
            out.add(pick)
    return names, out


@pytest.mark.parametrize("seed", range(3))
def test_patterns_equal_enumeration(spark, seed):
    nodes, edges, n, e = some_graph(spark, seed)
    a, b, c = Node("a", "F"), Node("b"), Node("c", ("C", "F"), "name <> 'n1'")
    fits = {"a": lambda lab, name: lab == "F", "b": lambda lab, name: True, "c": lambda lab, name: name != "n1"}
    for paths in (
        [[a, Edge("X"), b]],
        [[a, Edge(("X", "Y"), IN), b, Edge("Y", BOTH), c]],
        [[a, Edge("X", least=1, most=3), b], [b, Edge(), c]],
        [[a, Edge("X", least=2, most=2), c]],
        [[a, Edge("Y", BOTH, 1, 2), b, Edge("X"), c], [c, Edge("X", IN), a]],
        [[b, Edge("X"), b]],
    ):
        names, want = by_hand(nodes, edges, fits, [[x if isinstance(x, Edge) else x.name for x in p] for p in paths])
        rows = [tuple(r) for r in match(n, e, *paths).select(*names).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_zero_steps_named_edges_and_optional_parts(spark):
    n = as_nodes(spark.createDataFrame([("a", "F", "x"), ("b", "F", "y"), ("c", "C", "z")], "uid string, label string, name string"))
    e = as_edges(spark.createDataFrame([("a", "b", "X", 1), ("a", "b", "X", 2), ("b", "a", "X", None)], "src_uid string, dst_uid string, type string, line long"))
    rows = match(n, e, [Node("s", "F", "name = 'x'"), Edge("X", least=0, most=2), Node("t")]).collect()
    assert sorted((r["s"], r["t"]) for r in rows) == [("a", "a"), ("a", "b")]
    named = match(n, e, [Node("s"), Edge("X", name="k"), Node("t", where="name = 'y'")]).collect()
    assert sorted((r["s"], r["k_line"], r["k_type"]) for r in named) == [("a", 1, "X"), ("a", 2, "X")]
    rows = match(n, e, [Node("s")], optional=[[Node("s"), Edge("X"), Node("t", where="name = 'y'")], [Node("t"), Edge("X"), Node("w")]]).collect()
    assert sorted((r["s"], r["t"], r["w"]) for r in rows if r["t"]) == [("a", "b", "a")] and len(rows) == 3
    assert match(n, e.limit(0), [Node("s"), Edge(), Node("t")]).count() == 0 and match(n.limit(0), e, [Node("s")]).count() == 0


def test_what_is_no_pattern(spark):
    n, e = some_graph(spark, 1)[2:]
    for bad in (lambda: Edge(direction="up"), lambda: Edge(least=3, most=2), lambda: Edge(most=2, name="k"), lambda: match(n, e, [Edge()]), lambda: match(n, e, []), lambda: match(n, e, [Node("a"), Node("b")])):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        match(n, e, [Node("a")], [Node("b"), Edge(), Node("c")])
    with pytest.raises(ValueError):
        match(n, e, [Node("a")], optional=[[Node("b"), Edge(), Node("c")]])
