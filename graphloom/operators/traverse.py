"""Walks over edges: reach sets by joins of a frontier, trails by a recursive query."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a frontier is sent to all executors instead of shuffling the edges.
SMALL = 200_000
#: Steps taken at most between two writes.
AHEAD = 4


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        found = context._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: plans of loops stay short, and survive lost executors."""
    path = f"{_shared(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(*jobs: Callable[[], object]) -> list:
    """The results of jobs that do not need each other, run at once, so that the end of one leaves no core idle."""
    session = SparkSession.active()
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(session)(job)) for job in jobs]]


class Counts:
    """Aggregates of a table taken while it is written, so that no second pass is needed.

    Spark drops what it observes together with a part of a plan that turns out empty; then the
    written rows are aggregated.
    """

    def __init__(self, *aggregates: Column):
        self.aggregates, self.seen = aggregates, Observation()

    def of(self, df: DataFrame) -> DataFrame:
        return df.observe(self.seen, *self.aggregates)

    def get(self, written: DataFrame) -> dict:
        try:
            return self.seen.get
        except Py4JJavaError:
            return written.agg(*self.aggregates).first().asDict()


def forget_old(spark: SparkSession, hours: float = 24) -> int:
    """Delete tables that `cut` wrote so long ago; answers that still read them end with an error. Returns how many went."""
    place = spark._jvm.org.apache.hadoop.fs.Path(_shared(spark))
    fs, gone = place.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    if fs.exists(place):
        for x in fs.listStatus(place):
            if x.getPath().getName().startswith("cut-") and x.getModificationTime() < (time.time() - hours * 3600) * 1000:
                gone += bool(fs.delete(x.getPath(), True))
    return gone


def apart(df: DataFrame) -> DataFrame:
    """`df` as a side of a join that is shuffled, never broadcast: Spark goes by the bytes of compressed files, and a column of few of them may hold millions of rows."""
    return df.hint("merge")


def sized(df: DataFrame, most: int = SMALL) -> DataFrame:
    """`df`, broadcast in a join where it has at most `most` rows, and shuffled else."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else apart(df)


def spread(df: DataFrame, by: str) -> DataFrame:
    """`df` dealt out over all cores, for work that costs far more than reading its rows: a split of Parquet may hold millions of them."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, by)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as (a, b) in the walk's direction: out, in, or both."""
    out = edges.select(F.col("src_uid").alias("a"), F.col("dst_uid").alias("b"))
    back = edges.select(F.col("dst_uid").alias("a"), F.col("src_uid").alias("b"))
    return {"out": out, "in": back, "both": out.union(back)}[direction]


def _fanout(steps: DataFrame) -> int:
    """The most steps that leave one node."""
    return steps.groupBy("a").count().agg(F.max("count")).first()[0] or 0


def _ahead(rows: int, fanout: int, left: int) -> int:
    """How many steps to take before the next write: as many as can only have frontiers of SMALL rows, and one at least."""
    n = 1
    while n < min(left, AHEAD) and rows * fanout**n <= SMALL:
        n += 1
    return n


def distances(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(seed, uid, dist) with the least number of edges, up to `depth`, from each seed; the seeds themselves at 0.

    `seeds` has uid, or seed and uid. All seeds walk at once. The edges are written once, and
    with them the most that leave one node is known; so a frontier's rows bound those of the next
    ones. While the bound is small, frontiers are broadcast, the edges are scanned and not
    shuffled, and several steps are taken before the next write.
    """
    first = seeds if "seed" in seeds.columns else seeds.select(F.col("uid").alias("seed"), "uid")
    seen = cut(first.select("seed", "uid", F.lit(0).alias("dist")).distinct())
    if depth < 1:
        return seen
    frontier, steps, at = seen, cut(directed(edges, direction).distinct()), 0
    rows, fanout = frontier.count(), _fanout(steps)
    while rows and at < depth:
        level, met, n = frontier, None, _ahead(rows, fanout, depth - at)
        for k in range(n):
            ends = level.select("seed", F.col("uid").alias("a"))
            level = steps.join(F.broadcast(ends) if rows * fanout**k <= SMALL else ends, "a").select("seed", F.col("b").alias("uid")).distinct()
            new = level.withColumn("dist", F.lit(at + k + 1))
            met = new if met is None else met.unionByName(new)
        near = met if n == 1 else met.groupBy("seed", "uid").agg(F.min("dist").alias("dist"))
        near = cut(near.join(seen, ["seed", "uid"], "left_anti"))
        at += n
        frontier = near.where(F.col("dist") == at)
        rows = frontier.count()
        seen = seen.unionByName(near)
    return seen


def path_edges(seeds: DataFrame, edges: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """(seed, and the columns of `edges`) of all edges on a path of 1 to `depth` edges from a seed.

    Those are the edges that leave what is reached in fewer than `depth` steps, as a shortest path
    to an edge's start can always take it next.
    """
    near = distances(seeds, edges, depth - 1, direction).select("seed", F.col("uid").alias("_from"))
    end = "src_uid" if direction == "out" else "dst_uid"
    return edges.join(sized(near), edges[end] == F.col("_from")).drop("_from")


def ball(seeds: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, uid, dist) within `depth` edges of any type and direction."""
    return distances(seeds, edges, depth, "both")


def trails(seeds: DataFrame, edges: DataFrame, depth: int = 10, direction: str = "out", distinct: bool = False) -> DataFrame:
    """(seed, uid, length): one row per trail of 1 to `depth` edges, which uses no edge twice; with `distinct` one per reached node."""
    return multiplied(trail_counts(seeds, edges, depth, direction, distinct))


def multiplied(counts: DataFrame) -> DataFrame:
    """Each row as often as its column `n` says."""
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return counts.select(*(c for c in counts.columns if c != "n"), each.alias("_copy")).drop("_copy")


def trail_counts(seeds: DataFrame, edges: DataFrame, depth: int = 10, direction: str = "out", distinct: bool = False) -> DataFrame:
    """(seed, uid, length, n): how many trails of that length lead from a seed to a node; with `distinct` the shortest path alone.

    Walks are counted first, one row for each seed and node of a level. If they end before
    `depth`, or meet no node twice whose next edge could be used again, they are the trails. Else
    a second pass carries the used edges, but only those that may lie on a cycle, so that rows of
    one node with the same such edges are counted together; the rest of the graph costs no more.
    """
    if distinct:
        found = distances(seeds, edges, depth, direction)
        return found.where("dist > 0").select("seed", "uid", F.col("dist").alias("length"), F.lit(1).cast("long").alias("n"))
    first = seeds if "seed" in seeds.columns else seeds.select(F.col("uid").alias("seed"), "uid")
    first = cut(first.groupBy("seed", "uid").agg(F.count(F.lit(1)).alias("n")))
    steps = cut(directed(edges, direction).distinct())
    walks, ended = _levels(first, steps.withColumn("e", F.lit(None).cast(EDGE)), depth)
    if not ended:
        met = walks.select("seed", "uid", "length").unionByName(first.select("seed", "uid", F.lit(0).alias("length")))
        if not met.where(F.col("length") < depth).groupBy("seed", "uid").count().where("count > 1").isEmpty():
            loops = cyclic(_among(steps, met.select("uid").distinct()), depth)
            if loops is not None:
                marked = steps.join(sized(loops.withColumn("e", F.struct("a", "b"))), ["a", "b"], "left")
                walks, _ = _levels(first, cut(marked), depth)
    total = walks.groupBy("seed", "uid", "length").agg(F.try_sum("n").alias("n"))
    return total.withColumn("n", F.coalesce("n", F.raise_error(F.lit("more than 2**63 trails lead to one node")).cast("long")))


EDGE = "struct<a:string,b:string>"


def _levels(first: DataFrame, steps: DataFrame, depth: int) -> tuple[DataFrame, bool]:
    """(seed, uid, used, n, length) of walks that use no edge `e` twice, null being none, and whether they end before `depth`."""
    last = first.withColumn("used", F.array().cast(f"array<{EDGE}>"))
    out, at, rows, fanout = last.withColumn("length", F.lit(0)).limit(0), 0, first.count(), _fanout(steps)
    while rows and at < depth:
        level, made, ahead = last, None, _ahead(rows, fanout, depth - at)
        for k in range(ahead):
            ends = level.withColumnRenamed("uid", "a")
            met = steps.join(F.broadcast(ends) if rows * fanout**k <= SMALL else ends, "a")
            fresh = met.where(F.col("e").isNull() | ~F.array_contains("used", F.col("e")))
            used = F.when(F.col("e").isNull(), F.col("used")).otherwise(F.array_sort(F.array_append("used", F.col("e"))))
            level = fresh.select("seed", F.col("b").alias("uid"), used.alias("used"), "n").groupBy("seed", "uid", "used").agg(F.try_sum("n").alias("n"))
            new = level.withColumn("length", F.lit(at + k + 1))
            made = new if made is None else made.unionByName(new)
        made = cut(made)
        at += ahead
        out = made if at == ahead else out.unionByName(made)
        last = made.where(F.col("length") == at).drop("length")
        rows = last.count()
    return out, not rows


def _among(steps: DataFrame, ids: DataFrame) -> DataFrame:
    """The steps (a, b) with both ends among `ids`."""
    out = steps
    for end in "ab":
        out = out.join(sized(ids.withColumnRenamed("uid", end)), end, "left_semi")
    return out.select("a", "b")


def cyclic(steps: DataFrame, rounds: int) -> DataFrame | None:
    """Steps (a, b) among which are all that lie on a cycle: those left when ends without a way in or out are taken off, in up to `rounds` rounds; None if none are."""
    steps = cut(steps)
    left = steps.count()
    for _ in range(rounds):
        if not left:
            return None
        inner = steps.select(F.col("a").alias("uid")).intersect(steps.select(F.col("b").alias("uid")))
        steps, before = cut(_among(steps, inner)), left
        left = steps.count()
        if left == before:
            break
    return steps if left else None
