"""What several operators share: tables in the shared folder, text batches, hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once; one longer text is taken alone.
BLOCK = 1 << 18


def table(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, as in tests, and everything runs on one machine, a new one is made; on a
    cluster there is no folder that all machines could read, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


class Stage:
    """Tables written to the shared folder, so that a lost executor costs no more than one step."""

    #: Folders written since the last `forget`, in this driver.
    written: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        Stage.written.append(self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self) -> str:
        self.made += 1
        return f"{self.root}/{self.made}"

    def drop(self, number: int) -> None:
        """Delete a table that no later step reads."""
        delete(self.spark, f"{self.root}/{number}")

    @staticmethod
    def forget(spark: SparkSession, since: int) -> None:
        """Delete the folders that were begun after the first `since` ones, whose tables no later step reads."""
        for root in Stage.written[since:]:
            delete(spark, root)
        del Stage.written[since:]


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def few(ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """Narrow ids for a semi or anti join: sent to all executors if there are at most `most` (16 MB of longs), else left for a join that shuffles."""
    return F.broadcast(ids) if ids.count() <= most else ids


def text_blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows with about `most` bytes: first row, row after the last, UTF-8 texts (null: empty)."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, rows = 0, len(texts)
    while at < rows:
        total = np.cumsum(lengths[at:])
        end = at + max(1, int(np.searchsorted(total, most, side="right")))
        chunk = texts.slice(at, end - at).cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        yield at, end, [x or b"" for x in chunk.to_pylist()]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (an invertible multiply and shift hash); changes x in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Bytes of a span that are hashed eight at a time in numpy; longer ones are hashed one by one.
SPAN = 64


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans data[start:end] (int or long arrays); equal bytes have equal hashes.

    Eight bytes at a time are mixed into the state, which is not linear in them, so no pattern of
    bytes collides with another by construction, as it would in a polynomial modulo 2**64.
    """
    size = (end - start).astype(np.int64)
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    live = np.flatnonzero((size > 0) & (size <= SPAN))
    at = 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        chunk = np.ascontiguousarray(words[start[live] + at]).view(np.uint64).ravel()
        chunk &= np.uint64(2**64 - 1) >> ((8 - left).astype(np.uint64) * np.uint64(8))
        out[live] = mix(out[live] ^ mix(chunk + np.uint64(at)))
        at += 8
        live = live[size[live] > at]
    for k in np.flatnonzero(size > SPAN).tolist():
        out[k] ^= np.uint64(xxhash.xxh3_64_intdigest(data[start[k] : end[k]]))
    return mix(out)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`work` on a task's batches, after which the reused worker gives memory that is free back to the machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Give memory that is free back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply `work` to the Arrow batches of each partition.

    Batches of long texts would take much memory outside the JVM's heap in executors, twice where
    a buffer grows; so the session's default of 10,000 rows in a batch is lowered to 1,000. A
    number that the user has set otherwise stays.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH) == "10000":
        conf.set(BATCH, "1000")
    return df.mapInArrow(tidy(work), schema)


#: The setting of rows in an Arrow batch.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def components(stage: Stage, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each id of `edges` (a, b) reaches.

    Each round hooks every id to its smallest neighbour, follows those pointers twice and
    renames the ends of the edges; a hub costs one row of a map-side combined minimum.
    Ids without edges are absent. Null ends and self-loops are left out.
    """
    spark = stage.spark
    live = stage.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("to"))
        low = stage.keep(low)
        hop = low.select(F.col("id").alias("to"), F.col("to").alias("next"))
        for _ in range(2):
            low = low.join(hop, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        low = stage.keep(low)
        names = low.select(F.col("id").alias("component"), F.col("to").alias("next"))
        if found is None:
            found = low.select("id", F.col("to").alias("component"))
        else:
            found = stage.keep(found.join(names, "component", "left").select("id", F.coalesce("next", "component").alias("component")))
        to = {x: low.select(F.col("id").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab"}
        moved = live.join(to["a"], "a").join(to["b"], "b").where("to_a <> to_b")
        live = stage.keep(moved.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct())
    return found if found is not None else spark.createDataFrame([], "id long, component long")
