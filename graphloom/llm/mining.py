"""Hard negatives: products in a rotated basis, cut off early by bounds on what is not yet summed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stage, arrow_map

#: Rows of a shard and anchors of a block, about, that one task holds, and anchors of a strip.
SHARD_ROWS, ANCHOR_ROWS, STRIP = 4096, 2048, 256
#: Pairs whose whole products are made at once.
PAIRS = 1 << 16
LOW, HIGH = -(2**63), 2**63 - 1


def usable(rows: DataFrame, label: str | Column = "label") -> DataFrame:
    """(vec_id, label, dim, embedding) of the rows that take part: none of the three null, all components finite."""
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.col(label) if isinstance(label, str) else label
    kept = rows.where(F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull() & ok)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.size("embedding").alias("dim"), "embedding")


def grid(lists: pa.ChunkedArray | pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of all components, as doubles, which hold them exactly."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0)
    return np.floor(scale * flat.astype(np.float64)).reshape(len(lists), dim)


class Side:
    """Integer vectors of one side, and their rotated directions in single precision with the length of what follows each cut."""

    def __init__(self, whole: np.ndarray, turn: np.ndarray | None, cuts: list[int]):
        self.whole, top = whole, np.abs(whole).max(axis=1, initial=1.0)
        scaled = whole / top[:, None]
        length = np.linalg.norm(scaled, axis=1)
        unit = scaled / np.maximum(length, 1e-300)[:, None]
        unit = unit if turn is None else unit @ turn
        self.length, self.lead = length * top, unit.astype(np.float32)
        tail = np.concatenate([np.cumsum((unit**2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(unit), 1))], axis=1)
        self.rest = {m: np.sqrt(tail[:, m]) * (1 + 1e-6) + 1e-6 for m in cuts}


def exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the rows a[i] and b[j]: in doubles or longs where these cannot overflow, else in unbounded integers."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    a, b = (x.astype(kind) if kind is not object else np.vectorize(int, otypes=[object])(x) for x in (a, b))
    out = [(a[i[k : k + PAIRS]] * b[j[k : k + PAIRS]]).sum(axis=1) if kind is object else np.einsum("ij,ij->i", a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)]
    if not out:
        return np.zeros(0, np.int64)
    return np.array([min(max(x, LOW), HIGH) for x in np.concatenate(out)], np.int64) if kind is object else np.concatenate(out).astype(np.int64)


def survivors(anchors: Side, rows: Side, at: slice, cuts: list[int], allowed: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) that no bound rules out.

    For directions u, w with leading parts u', w' and remainders of lengths r, s: |u.w - u'.w'| <=
    r * s, and single precision adds at most (m + 8) / 2**23. After each cut `keep(lower, upper)`
    says which pairs may still count, from bounds in units of the score; leading products go on
    only as long as many are left.
    """
    alive, product, done = allowed, np.zeros(allowed.shape, np.float32), 0
    scale = anchors.length[at][:, None] * rows.length[None]
    for m in cuts:
        product += anchors.lead[at, done:m] @ rows.lead[:, done:m].T
        done = m
        slack = anchors.rest[m][at][:, None] * rows.rest[m][None] + (m + 8) / 2**23
        alive = alive & keep(np.where(alive, (product - slack) * scale, -np.inf), np.where(alive, (product + slack) * scale, -np.inf))
        if alive.sum() < 0.05 * alive.size:
            break
    return np.nonzero(alive)


def nth_largest(x: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row; minus infinity where there are fewer."""
    return -np.partition(-x, n - 1, axis=1)[:, n - 1 : n] if x.shape[1] >= n else np.full((len(x), 1), -np.inf)


def first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Indices of the first n of each group, by descending score and ascending id."""
    order = np.lexsort((ids, -score.astype(np.float64) if np.abs(score).max(initial=0) < 2**53 else [-int(x) for x in score], group))
    own = group[order]
    start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    return order[np.arange(len(own)) - np.repeat(start, np.diff(np.r_[start, len(own)])) < n]


def rotation(rows: DataFrame, scale: float) -> tuple[int, np.ndarray | None]:
    """The most common vector length, and the principal axes of all vectors of it, the strongest first (columns; None without rows).

    Second moments are summed over all rows, d * d numbers for each task, which Spark adds up.
    """
    most = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if most is None or not most["dim"]:
        return 0, None
    dim = most["dim"]

    def work(batches):
        total, seen = np.zeros((dim, dim)), False
        for batch in batches:
            x = grid(batch.column(0), dim, scale)
            x = x / np.maximum(np.abs(x).max(axis=1, initial=0), 1)[:, None] if np.abs(x).max(initial=0) > 2**40 else x
            total += x.T @ x
            seen = True
        if seen:
            i, j = np.triu_indices(dim)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    sums = arrow_map(rows.where(F.col("dim") == dim).select("embedding"), work, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    moments = np.zeros((dim, dim))
    for i, j, v in sums.collect():  # d * d / 2 rows, whatever the input
        moments[i, j] = moments[j, i] = v
    return dim, np.linalg.eigh(moments)[1][:, ::-1]


def _cuts(dim: int) -> list[int]:
    return sorted({max(1, dim // 4), max(1, dim // 2), dim}) if dim else [0]


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, label: str | Column = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` has vec_id, label and embedding; `anchors` says which of its rows are anchors. Scores
    are inner products of floor(scale * x). An anchor's positives are its first `positives` other
    rows of its label, by descending score and ascending vec_id; its negatives for one of these
    are the first `negatives` rows of other labels with low % to high % of its score.

    Rows with a null id, label, vector or component, or one that is not finite, take no part, and
    vectors of different lengths never meet; rows of an anchor's own id are no others. Zero
    vectors score 0. Rows that repeat an id count one by one, as anchors too. Scores that a long
    cannot hold are set to the nearest long. Other columns are not read; no rows give no rows.

    Rows are dealt to shards of about 4,096, positives' within a label, negatives' over all
    labels, and anchors to blocks, so a label may hold any share of the rows. Each block meets
    each shard in one task, which returns a few rows for each of its anchors. Within a task,
    leading products in the basis of the principal axes bound the scores; what may still count is
    verified by integer products.
    """
    stage = Stage(rows.sparkSession, "mining")
    held = stage.keep(usable(rows, label).withColumn("key", F.monotonically_increasing_id()))
    dim, turn = rotation(held, scale)
    own = lambda n, seed: F.pmod(F.xxhash64("key", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    blocks = lambda n, size: F.ceil(n / F.lit(size))
    asked = stage.keep(held.where(anchors))

    def dealt(by: list[str], asking: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows with a shard, once for each block of the anchors that they may meet, and anchors the other way round."""
        counts = held.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
        counts = counts.join(asking.groupBy(*by).agg(F.count(F.lit(1)).alias("m")), by)
        shards, parts = blocks(F.col("n"), SHARD_ROWS), blocks(F.col("m"), ANCHOR_ROWS)
        given = held.join(counts, by).select(*held.columns, own(shards, 0).alias("shard"), each(parts).alias("block"))
        return given, asking.join(counts, by).select(*asking.columns, own(parts, 1).alias("block"), each(shards).alias("shard"))

    def sides(given: pa.Table, ask: pa.Table) -> tuple[Side, Side, list[int], np.ndarray, np.ndarray]:
        d = given.column("dim")[0].as_py()
        cuts = _cuts(d)
        left, right = (Side(grid(t.column("embedding"), d, scale), turn if d == dim else None, cuts) for t in (ask, given))
        return left, right, cuts, ask.column("vec_id").to_numpy(), given.column("vec_id").to_numpy()

    def near(given: pa.Table, ask: pa.Table) -> pa.Table:
        """The first positives of each anchor in this shard of its label."""
        out = []
        if given.num_rows and ask.num_rows:
            left, right, cuts, asking, ids = sides(given, ask)
            keys = ask.column("key").to_numpy()
            for k in range(0, len(keys), STRIP):
                at = slice(k, min(k + STRIP, len(keys)))
                keep = lambda lower, upper: upper >= nth_largest(lower, positives)
                i, j = survivors(left, right, at, cuts, ids[None] != asking[at][:, None], keep)
                score = exact(left.whole[at], right.whole, i, j)
                best = first(i, score, ids[j], positives)
                out.append((keys[at][i[best]], ids[j[best]], score[best]))
        c = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"key": c[0], "positive_id": c[1], "score": c[2]})

    given, ask = dealt(["dim", "label"], asked)
    at = ["dim", "label", "shard", "block"]
    found = given.groupBy(*at).cogroup(ask.groupBy(*at)).applyInArrow(near, "key long, positive_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
    found = found.groupBy("key").agg(F.collect_list(F.struct("place", "positive_id", "score")).alias("near"))
    asking = stage.keep(asked.join(found, "key"))

    def hard(given: pa.Table, ask: pa.Table) -> pa.Table:
        """The first negatives in this shard for each anchor and positive."""
        out = []
        if given.num_rows and ask.num_rows:
            left, right, cuts, _, ids = sides(given, ask)
            keys, mine, others, held_near = ask.column("key").to_numpy(), ask.column("label").to_numpy(), given.column("label").to_numpy(), ask.column("near").to_pylist()
            for k in range(0, len(keys), STRIP):
                at = slice(k, min(k + STRIP, len(keys)))
                windows = _windows(held_near[at], positives, low, high)

                def keep(lower: np.ndarray, upper: np.ndarray, windows: list = windows) -> np.ndarray:
                    out = np.zeros(lower.shape, bool)
                    for _, _, least, most, edge in windows:
                        within = np.where((lower >= least + edge) & (upper <= most - edge), lower, -np.inf)
                        out |= (lower <= most + edge) & (upper >= np.maximum(least - edge, nth_largest(within, negatives)))
                    return out

                i, j = survivors(left, right, at, cuts, mine[at][:, None] != others[None], keep)
                score = exact(left.whole[at], right.whole, i, j)
                for place, (lows, highs, *_) in enumerate(windows):
                    fit = np.flatnonzero((score >= lows[i]) & (score <= highs[i]))
                    best = fit[first(i[fit], score[fit], ids[j[fit]], negatives)]
                    out.append((keys[at][i[best]], np.full(len(best), place + 1), ids[j[best]], score[best]))
        c = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table({"key": c[0], "place": pa.array(c[1], pa.int32()), "negative_id": c[2], "negative_score": c[3]})

    given, ask = dealt(["dim"], asking)
    at = ["dim", "shard", "block"]
    met = given.groupBy(*at).cogroup(ask.groupBy(*at)).applyInArrow(hard, "key long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    met = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = asking.select("key", F.col("vec_id").alias("anchor_id"), F.inline("near")).withColumnRenamed("score", "positive_score")
    return met.join(pairs, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _windows(near: list[list[dict]], positives: int, low: int, high: int) -> list[tuple[np.ndarray, ...]]:
    """For each place of a positive: least and greatest score of its negatives by anchor, as longs and as doubles, and what those may be off by."""
    lows, highs = np.full((positives, len(near)), 1, np.int64), np.zeros((positives, len(near)), np.int64)
    for k, found in enumerate(near):
        for x in found:
            lows[x["place"] - 1, k], highs[x["place"] - 1, k] = -(-low * x["score"] // 100), high * x["score"] // 100
    return [(a, b, a[:, None].astype(float), b[:, None].astype(float), 1e-9 * np.maximum(np.abs(a), np.abs(b))[:, None] * (np.abs(b) > 2**50)[:, None]) for a, b in zip(lows, highs, strict=True)]
