"""Path patterns over a graph: nodes joined by edges that may repeat, bound in the order of their counted selectivity.

    match(nodes, edges, [Node("c", "Class", "name = 'Base'"), Edge("CONTAINS"), Node("m", "Function"), Edge("CALLS", most=3), Node("t")])

gives a row (c, m, t) of uids for each way to bind the names so that all edges are there. Edges
that are not named do not multiply rows, however many join two nodes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import traverse

OUT, IN, BOTH = "out", "in", "both"


@dataclass
class Node:
    """A node by a name, of some labels (all if none), for which a condition on its properties holds."""

    name: str
    labels: str | Sequence[str] = ()
    where: str | Column | None = None

    def condition(self) -> Column:
        labels = [self.labels] if isinstance(self.labels, str) else list(self.labels)
        out = F.col("label").isin(*labels) if labels else F.lit(True)
        where = F.expr(self.where) if isinstance(self.where, str) else self.where
        return out if where is None else out & F.coalesce(where, F.lit(False))


@dataclass
class Edge:
    """`least` to `most` edges of some types (all if none) one after the other; a single one with a name gives its type and line too."""

    types: str | Sequence[str] = ()
    direction: str = OUT
    least: int = 1
    most: int = 1
    name: str | None = None

    def __post_init__(self) -> None:
        if self.direction not in (OUT, IN, BOTH) or not 0 <= self.least <= self.most or (self.name and self.most > 1):
            raise ValueError(f"no such edge: {self}")

    def steps(self, edges: DataFrame) -> DataFrame:
        """(a, b, type, line) in the edge's direction."""
        types = [self.types] if isinstance(self.types, str) else list(self.types)
        rows = edges.where(F.col("type").isin(*types)) if types else edges
        out = rows.select(F.col("src_uid").alias("a"), F.col("dst_uid").alias("b"), "type", "line")
        back = rows.select(F.col("dst_uid").alias("a"), F.col("src_uid").alias("b"), "type", "line")
        return {OUT: out, IN: back, BOTH: out.unionByName(back.where("a <> b"))}[self.direction]

    def turned(self) -> Edge:
        return Edge(self.types, {OUT: IN, IN: OUT, BOTH: BOTH}[self.direction], self.least, self.most, self.name)


@dataclass
class _Plan:
    """Conditions by name, and steps (from, edge, to) that are still to be taken."""

    conditions: dict[str, Column] = field(default_factory=dict)
    steps: list[tuple[str, Edge, str]] = field(default_factory=list)

    def add(self, path: Sequence[Node | Edge]) -> None:
        if not path or any(isinstance(x, Edge) == (k % 2 == 0) for k, x in enumerate(path)) or len(path) % 2 == 0:
            raise ValueError("a path is nodes with edges between them")
        for node in path[::2]:
            before = self.conditions.get(node.name)
            self.conditions[node.name] = node.condition() if before is None else before & node.condition()
        self.steps += [(path[k].name, path[k + 1], path[k + 2].name) for k in range(0, len(path) - 2, 2)]


def reach(seeds: DataFrame, steps: DataFrame, least: int, most: int) -> DataFrame:
    """(seed, uid): what a walk of `least` to `most` of the steps (a, b) leads to from each seed (column seed), every pair once.

    Each length is a set of pairs, written every few steps; so rows never count walks.
    """
    level = seeds.select("seed", F.col("seed").alias("uid")).distinct()
    steps = traverse.cut(steps.select("a", "b").distinct())
    out = level if least == 0 else None
    for length in range(1, most + 1):
        ends = level.withColumnRenamed("uid", "a")
        level = traverse.cut(steps.join(traverse.sized(ends), "a").select("seed", F.col("b").alias("uid")).distinct())
        if length >= least:
            out = level if out is None else out.unionByName(level)
        if level.isEmpty():
            break
    return out.distinct() if out is not None else level


def match(nodes: DataFrame, edges: DataFrame, *paths: Sequence[Node | Edge], optional: Sequence[Sequence[Node | Edge]] = ()) -> DataFrame:
    """A row of uids by name for each way to bind all paths; paths that share a name meet there.

    One scan counts the nodes that each name can be. The rarest is bound first; then always the
    step that leads on to the rarest name, single edges before repeated ones, and steps between
    names that are both bound, which only leave rows out, before all others. Repeated edges are
    reach sets of the distinct bound nodes, so their pairs are found once however many rows share
    them. An optional path must hold a bound name; where it cannot be bound its other names are
    null. Paths that share no name with the others are refused, as they would be a product.
    """
    plan = _Plan()
    for path in paths:
        plan.add(path)
    names = list(plan.conditions)
    counts = nodes.agg(*(F.count_if(c).alias(n) for n, c in plan.conditions.items())).first().asDict()
    first = min(names, key=lambda n: (counts[n], names.index(n)))
    bound = nodes.where(plan.conditions[first]).select(F.col("uid").alias(first))
    bound, _ = _bind(bound, {first}, plan, nodes, edges, counts)
    for path in optional:
        more = _Plan()
        more.add(path)
        shared = [n for n in more.conditions if n in bound.columns]
        if not shared:
            raise ValueError("an optional path must hold a bound name")
        start = nodes.where(more.conditions[shared[0]]).select(F.col("uid").alias(shared[0])).join(bound.select(shared[0]).distinct(), shared[0], "left_semi")
        sizes = nodes.agg(*(F.count_if(c).alias(n) for n, c in more.conditions.items())).first().asDict()
        found, _ = _bind(start, {shared[0]}, more, nodes, edges, sizes)
        bound = bound.join(found, shared, "left")
    return bound


def _bind(bound: DataFrame, there: set[str], plan: _Plan, nodes: DataFrame, edges: DataFrame, counts: dict[str, int]) -> tuple[DataFrame, set[str]]:
    todo = list(plan.steps)
    while todo:
        ready = [s for s in todo if s[0] in there or s[2] in there]
        if not ready:
            raise ValueError("paths that share no name")
        step = min(ready, key=lambda s: (not {s[0], s[2]} <= there, s[1].most > 1, counts[s[2] if s[0] in there else s[0]]))
        todo.remove(step)
        near, edge, far = step
        if near not in there:
            near, edge, far = far, edge.turned(), near
        single = edge.least == edge.most == 1
        pairs = edge.steps(edges)
        if single:
            held = [F.col("a").alias(near), F.col("b").alias("_far")]
            extra = [F.col("type").alias(f"{edge.name}_type"), F.col("line").alias(f"{edge.name}_line")] if edge.name else []
            pairs = pairs.select(*held, *extra) if edge.name else pairs.select(*held).distinct()
        else:
            pairs = reach(bound.select(F.col(near).alias("seed")).distinct(), pairs, edge.least, edge.most).select(F.col("seed").alias(near), F.col("uid").alias("_far"))
        if far in there:
            meets = pairs.where(F.col("_far") == F.col(near)).drop("_far") if far == near else pairs.withColumnRenamed("_far", far)
            bound = bound.join(meets, [near] if far == near else [near, far])
        else:
            fit = nodes.where(plan.conditions[far]).select(F.col("uid").alias("_far"))
            bound = bound.join(pairs.join(fit, "_far", "left_semi"), near).withColumnRenamed("_far", far)
            there = there | {far}
    return bound, there


def properties(bound: DataFrame, nodes: DataFrame, wanted: dict[str, Sequence[str]]) -> DataFrame:
    """`bound` with columns name_property of the nodes that names stand for; null where a name is not bound."""
    for name, columns in wanted.items():
        held = nodes.select(F.col("uid").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in columns))
        bound = bound.join(held, name, "left")
    return bound
