"""A change feed as a stream: files of changes become versions of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..plans.engine import Engine
from ..sources import git_feed

SCHEMA = "path string, status string, content string, seq long"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Changes from JSON lines files as they appear."""
    return spark.readStream.schema(SCHEMA).json(folder)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """Changed source files and documents of a git working copy, commit by commit, as a stream."""
    changed = git_feed.load(spark, folder, stream=True).withColumn("seq", F.lit(0).cast("long"))
    return changed.where((X.language("path").isNotNull() | X.is_document("path")) & ~X.excluded("path"))


def last_of_each(batch: DataFrame) -> DataFrame:
    """The last change of each path in a batch."""
    w = Window.partitionBy("path").orderBy(F.desc("seq"), F.desc("status"))
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def apply(stream: DataFrame, engine: Engine, checkpoint: str, repository: str | None = None) -> StreamingQuery:
    """Apply every batch and stop when all that is there has been read. A batch that is replayed after a failure changes nothing, as it deletes before it adds."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            engine.apply(last_of_each(batch).select("path", "status", "content"), repository)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
