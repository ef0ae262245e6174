"""Registered queries by path patterns over the derived graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.pattern import BOTH, IN, Edge, Node, match, properties
from .derived import edges_of, nodes_of, query


@query("pattern_calls_of_methods", graph_sql="""
, s AS (SELECT DISTINCT c.uid AS c, m.uid AS m FROM nodes c JOIN edges e ON e.src_uid = c.uid AND e.type = 'CONTAINS' JOIN nodes m ON m.uid = e.dst_uid AND m.label = 'Function' WHERE c.label = 'Class' AND c.name = 'Supplier#000000005'),
walk AS (SELECT m, m AS uid, 0 AS d FROM s UNION SELECT w.m, e.dst_uid, w.d + 1 FROM walk w JOIN edges e ON e.type = 'CALLS' AND e.src_uid = w.uid WHERE w.d < 3)
SELECT DISTINCT s.c, s.m, t.uid AS t, t.name AS t_name FROM s JOIN walk w USING (m) JOIN nodes t ON t.uid = w.uid AND t.label = 'Function' WHERE w.d > 0""", recursive=True)  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    nodes = nodes_of(spark, d)
    found = match(nodes, edges_of(spark, d), [Node("c", "Class", "name = 'Supplier#000000005'"), Edge("CONTAINS"), Node("m", "Function"), Edge("CALLS", most=3), Node("t", "Function")])
    return properties(found, nodes, {"t": ["name"]})


@query("pattern_optional_part", graph_sql="""
SELECT m.uid AS m, m.name AS m_name, c.uid AS c, c.name AS c_name FROM nodes m
LEFT JOIN (SELECT e.src_uid, c.uid, c.name FROM edges e JOIN nodes c ON c.uid = e.dst_uid AND c.label = 'Class' AND c.name LIKE '%7' WHERE e.type = 'CONTAINS') c ON c.src_uid = m.uid
WHERE m.label = 'Module' AND m.name LIKE 'NATION_1%'""")  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    nodes = nodes_of(spark, d)
    module = Node("m", "Module", F.col("name").like("NATION_1%"))
    found = match(nodes, edges_of(spark, d), [module], optional=[[Node("m"), Edge("CONTAINS"), Node("c", "Class", "name like '%7'")]])
    return properties(found, nodes, {"m": ["name"], "c": ["name"]})


@query("pattern_both_ways", graph_sql="""
, i AS (SELECT src_uid AS a, dst_uid AS b FROM edges WHERE type = 'INHERITS'), u AS (SELECT a, b FROM i UNION SELECT b, a FROM i)
SELECT DISTINCT u.a, u.b, m.src_uid AS m FROM nodes n JOIN u ON u.a = n.uid JOIN edges m ON m.type = 'CONTAINS' AND m.dst_uid = u.b JOIN nodes o ON o.uid = m.src_uid AND o.label = 'Module'
WHERE n.label = 'Class' AND n.start_line % 10 = 3""")  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    a, b = Node("a", "Class", "start_line % 10 = 3"), Node("b", "Class")
    return match(nodes_of(spark, d), edges_of(spark, d), [a, Edge("INHERITS", BOTH), b], [b, Edge("CONTAINS", IN), Node("m", "Module")]).select("a", "b", "m")


@query("pattern_closed", graph_sql="""
SELECT DISTINCT x.src_uid AS a, x.dst_uid AS b, y.dst_uid AS c, y.line AS y_line, y.type AS y_type, n.name AS a_name FROM edges x JOIN edges y ON y.type = 'INHERITS' AND y.src_uid = x.dst_uid
JOIN edges z ON z.type = 'INHERITS' AND z.src_uid = x.src_uid AND z.dst_uid = y.dst_uid JOIN nodes n ON n.uid = x.src_uid WHERE x.type = 'INHERITS'""")  # fmt: skip
def _(spark: SparkSession, d: str) -> DataFrame:
    """Classes that inherit of another twice, straight and by a third: three edges that close on each other."""
    nodes = nodes_of(spark, d)
    a, b, c = (Node(x, "Class") for x in "abc")
    found = match(nodes, edges_of(spark, d), [a, Edge("INHERITS"), b, Edge("INHERITS", name="y"), c], [a, Edge("INHERITS"), c])
    return properties(found.select("a", "b", "c", "y_line", "y_type"), nodes, {"a": ["name"]})
