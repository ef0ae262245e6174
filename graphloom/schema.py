"""The two tables of a graph: labelled nodes with a wide set of properties, and typed directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = ("Function", "Class", "Module", "Document")
#: USES_TYPE is declared, and has no producer.
EDGE_TYPES = ("CONTAINS", "CALLS", "INHERITS", "IMPORTS", "REFERENCES", "USES_TYPE")
#: Labels that carry a vector.
VECTOR_LABELS = ("Function", "Class", "Document")

_STRINGS = ("name", "file", "path", "signature", "docstring", "code_snippet", "language", "fqn", "title", "section", "content", "content_hash", "repository")
NODES = T.StructType(
    [
        T.StructField("uid", T.StringType()),
        T.StructField("label", T.StringType()),
        *(T.StructField(c, T.StringType()) for c in _STRINGS),
        *(T.StructField(c, T.LongType()) for c in ("start_line", "end_line", "level")),
        *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("base_classes", "imports", "code_references")),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("src_uid", T.StringType()),
        T.StructField("dst_uid", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("line", T.LongType()),
    ]
)


def uid(label: str | Column = "label", file: str | Column = "file", name: str | Column = "name", line: str | Column = "start_line") -> Column:
    """`label:file:name:line`; missing parts are empty, a missing line is 0."""
    text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    number = F.coalesce((F.col(line) if isinstance(line, str) else line).cast("long"), F.lit(0)).cast("string")
    return F.concat_ws(":", text(label), text(file), text(name), number)


def as_nodes(df: DataFrame) -> DataFrame:
    """`df` with exactly the columns of NODES; absent ones are null, and uid is made where it is absent."""
    if "uid" not in df.columns:
        for c, kind in (("label", "string"), ("file", "string"), ("name", "string"), ("start_line", "long")):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast(kind))
        df = df.withColumn("uid", uid())
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in NODES.fields))


def as_edges(df: DataFrame) -> DataFrame:
    """`df` with exactly the columns of EDGES."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EDGES.fields))
