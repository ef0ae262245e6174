"""Exact nearest vectors by a metric partition: cells around pivots, whose rows are skipped where angles prove them too far."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import search

#: Vectors of a label, about, that pivots are fitted on (by a hash of the id; at most twice as many), and most pivots of a label.
SAMPLE, PIVOTS = 4096, 512
#: Added to every bound on an angle: an arc cosine in doubles is off by less than 2e-8 where the cosine is off by 2e-16.
SLACK = 1e-6
#: Ranges of cells that a filter names one by one, so that Parquet's statistics skip the others; with more they are joined.
NAMED = 64
#: Queries that are sent to all executors at once, with their angles to all pivots.
BLOCK = 1024


class VectorIndex:
    """Rows of vectors below `path`, sorted by cell and angle, and a small table of cells.

    A row lies in the cell of the pivot at the smallest angle, of those of its label and number of
    components. Two bounds hold for the angle between a query and a row: it is at least the
    difference of their angles to the row's pivot, and at least half of what that pivot is farther
    from the query than the nearest one. A first scan of the cells nearest to the query gives `k`
    scores; the smallest of them is the radius of the second, which reads only cells, and of those
    only angles, that may lie within. Answers are those of a scan of all rows. Vectors that are null, empty or zero
    or hold null or non-finite components are in no answer.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "uid", kind: str = "string", vectors: str = "array<float>"):
        self.spark, self.path, self.id_col = spark, path, id_col
        self.schema = StructType.fromDDL(f"`{id_col}` {kind}, cell int, angle double, embedding {vectors}, label string")
        self._cells: pd.DataFrame | None = None

    @property
    def cells(self) -> pd.DataFrame:
        """cell, label, dim, pivot, rows, low, high: at most PIVOTS rows for each label and number of components."""
        if self._cells is None:
            self._cells = self.spark.read.parquet(f"{self.path}/cells").toPandas()
        return self._cells

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def nearest(self, vector: list[float], k: int = 10, labels: tuple[str, ...] = (), live: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """(id, cell, angle, embedding, label, score) of the `k` rows of largest cosine; of `labels`, if given, and among those that `live` leaves."""
        return search.vector_search(live(self.reach(vector, k, labels, live)), vector, k, labels, self.id_col)

    def reach(self, vector: list[float], k: int, labels: tuple[str, ...] = (), live: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """The rows that may be among the `k` nearest, by a first scan of the nearest cells; without those of other labels."""
        query, cells = np.array(vector, float), self.cells
        cells = cells[(cells["dim"] == len(query)) & (cells["label"].isin(labels) if labels else True)]
        if not len(cells) or not np.isfinite(query).all() or not query.any():
            return self.rows().limit(0)
        alpha, bound = _angles(cells, query[None, :] / np.linalg.norm(query))
        home = _home(alpha, cells["rows"].to_numpy(), k)[0]
        radius = np.pi
        if not home.all():
            first = search.vector_search(live(self._ranges(cells[home], None, None)), vector, k, labels, self.id_col).agg(F.count("score").alias("n"), F.min("score").alias("t")).first()
            if first["n"] == k:
                radius = float(np.arccos(np.clip(first["t"], -1, 1))) + SLACK
        near = bound[0] <= radius
        return self._ranges(cells[near], alpha[0][near] - radius, alpha[0][near] + radius)

    def _ranges(self, cells: pd.DataFrame, low: np.ndarray | None, high: np.ndarray | None) -> DataFrame:
        """Rows of some cells whose angle lies in the cell's range."""
        low = cells["low"].to_numpy() if low is None else np.maximum(low, cells["low"])
        high = cells["high"].to_numpy() if high is None else np.minimum(high, cells["high"])
        some = pd.DataFrame({"cell": cells["cell"].to_numpy(), "lo": low, "hi": high})
        rows = self.rows()
        if not len(some):
            return rows.limit(0)
        if len(some) <= NAMED:
            met: Column = F.lit(False)
            for r in some.itertuples():
                met = met | (F.col("cell") == int(r.cell)) & F.col("angle").between(float(r.lo), float(r.hi))
            return rows.where(met)
        ranges = self.spark.createDataFrame(some, "cell int, lo double, hi double")
        return rows.join(F.broadcast(ranges), "cell").where(F.col("angle").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")

    def nearest_many(self, queries: DataFrame, k: int = 10, scored: Accumulator | None = None) -> DataFrame:
        """(query_id, rank, id, score) for a stated set of queries (query_id, vector), as `search.vector_search_many` gives them.

        Each block of BLOCK queries takes two scans of the rows in reach of any of them; a row meets
        only the queries that reach it. `scored` is added the pairs whose cosine was computed.
        """
        asked, kind = queries.where("vector is not null").select("query_id", "vector"), queries.schema["query_id"].dataType.simpleString()
        blocks = max(1, -(-asked.count() // (BLOCK * 3 // 4)))
        found = self.spark.createDataFrame([], f"query_id {kind}, `{self.id_col}` {self.schema[self.id_col].dataType.simpleString()}, score double")
        for block in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toPandas()
            for dim, part in own.groupby(own["vector"].map(len)):
                vectors = np.array(part["vector"].tolist(), float).reshape(len(part), dim)
                size = np.linalg.norm(vectors, axis=1)
                sound, cells = np.isfinite(size) & (size > 0), self.cells[self.cells["dim"] == dim]
                if sound.any() and len(cells):
                    found = found.unionByName(self._block(part["query_id"].to_numpy()[sound], vectors[sound] / size[sound, None], cells, k, kind, scored))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), self.id_col)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", self.id_col, "score")

    def _block(self, names: np.ndarray, units: np.ndarray, cells: pd.DataFrame, k: int, kind: str, scored: Accumulator | None) -> DataFrame:
        alpha, bound = _angles(cells, units)
        home = _home(alpha, cells["rows"].to_numpy(), k)
        least, radius = np.full(len(units), -2.0), np.full(len(units), np.pi)
        if not home.all():
            place = pd.Series(np.arange(len(names)), index=names)
            first = self._scan(names, units, cells, alpha, home, np.full(len(units), np.inf), least, k, kind, scored)
            best = Window.partitionBy("query_id").orderBy(F.desc("score"))
            last = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query_id", "score").toPandas()
            at = place[last["query_id"]].to_numpy()
            least[at] = last["score"] - 1e-12
            radius[at] = np.arccos(np.clip(last["score"], -1, 1)) + SLACK
        return self._scan(names, units, cells, alpha, bound <= radius[:, None], radius, least, k, kind, scored)

    def _scan(self, names: np.ndarray, units: np.ndarray, cells: pd.DataFrame, alpha: np.ndarray, near: np.ndarray, radius: np.ndarray, least: np.ndarray, k: int, kind: str, scored: Accumulator | None) -> DataFrame:
        """(query_id, id, score) of each batch's best `k` and their ties, of scores from `least` on; cell by cell, for the queries `near` to it."""
        used = near.any(axis=0)
        low = np.where(near, alpha - radius[:, None], np.inf).min(axis=0)[used]
        high = np.where(near, alpha + radius[:, None], -np.inf).max(axis=0)[used]
        column, id_col = {int(c): n for n, c in enumerate(cells["cell"])}, self.id_col
        keys = names.tolist()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.to_pandas()
                for cell, part in own.groupby("cell"):
                    c = column[int(cell)]
                    asked = np.flatnonzero(near[:, c])
                    matrix = np.array(part["embedding"].tolist(), float)
                    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
                    met = np.abs(alpha[asked, c][:, None] - part["angle"].to_numpy()[None, :]) <= radius[asked][:, None]
                    if scored is not None:
                        scored.add(int(met.sum()))
                    score = np.where(met, units[asked] @ matrix.T, -3.0)
                    floor = least[asked] - 1e-12
                    if score.shape[1] > k:
                        floor = np.maximum(floor, np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k] - 1e-12)
                    q, row = np.nonzero((score >= floor[:, None]) & met)
                    if not len(q):
                        continue
                    # again, as one sum for each pair, so that equal vectors have equal scores
                    exact = (units[asked[q]] * matrix[row]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array([keys[x] for x in asked[q]]), pa.array(part[id_col].to_numpy()[row]), pa.array(exact, pa.float64())], ["query_id", id_col, "score"])

        rows = self._ranges(cells[used], low, high).select(id_col, "cell", "angle", "embedding")
        return rows.mapInArrow(work, f"query_id {kind}, `{id_col}` {self.schema[id_col].dataType.simpleString()}, score double")


def _angles(cells: pd.DataFrame, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of queries and cells: the angle to the cell's pivot, and a lower bound of that to any row of the cell."""
    alpha = np.arccos(np.clip(units @ np.array(cells["pivot"].tolist(), float).T, -1, 1))
    bound = np.maximum(alpha - cells["high"].to_numpy(), cells["low"].to_numpy() - alpha)
    groups = cells["label"].fillna("\0").to_numpy()
    for label in set(groups):
        own = groups == label
        bound[:, own] = np.maximum(bound[:, own], (alpha[:, own] - alpha[:, own].min(axis=1)[:, None]) / 2)
    return alpha, bound - SLACK


def _home(alpha: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Of each query the nearest cells that together hold at least `k` rows."""
    order = np.argsort(alpha, axis=1, kind="stable")
    before = np.cumsum(rows[order], axis=1) - rows[order]
    home = np.zeros(alpha.shape, bool)
    np.put_along_axis(home, order, before < k, axis=1)
    return home


def build(rows: DataFrame, path: str, id_col: str = "uid", sample: int = SAMPLE, pivots: int = PIVOTS) -> VectorIndex | None:
    """Write an index of the columns id, label and embedding of `rows`; None if there is no vector.

    A label of `n` vectors gets about the square root of `n` pivots, fitted on a bounded sample;
    every row is indexed. Hot cells are split among tasks as they are written.
    """
    spark = rows.sparkSession
    held = rows.select(id_col, F.col("label").cast("string").alias("label"), F.size("embedding").alias("dim"), "embedding").where("dim > 0")
    sizes = {(r["label"], r["dim"]): r["n"] for r in held.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.coalesce(*(F.when(F.col("label").eqNullSafe(label) & (F.col("dim") == dim), F.lit(min(1.0, sample / n))) for (label, dim), n in sizes.items()))
    some = held.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * sample * len(sizes)).select("label", "dim", "embedding").toPandas()
    fitted: dict[tuple[str | None, int], tuple[int, np.ndarray]] = {}
    start = 0
    for (label, dim), n in sizes.items():
        own = some[(some["label"].isna() if label is None else some["label"] == label) & (some["dim"] == dim)]
        found = _fit(_units(own["embedding"].tolist(), dim)[0], min(pivots, int(np.ceil(np.sqrt(n)))))
        fitted[label, dim] = start, found
        start += len(found)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(["label", "dim"]).to_pandas()
            cell, angle = np.full(len(own), -1, np.int32), np.zeros(len(own))
            vectors = batch.column(batch.schema.get_field_index("embedding"))
            for (label, dim), part in own.groupby(["label", "dim"], dropna=False):
                first, known = fitted[None if pd.isna(label) else label, int(dim)]
                units, sound = _units(vectors.take(pa.array(part.index)).flatten().to_numpy(zero_copy_only=False), int(dim))
                at = part.index.to_numpy()[sound]
                near = units @ known.T
                best = near.argmax(axis=1)
                cell[at], angle[at] = best + first, np.arccos(np.clip(near[np.arange(len(at)), best], -1, 1))
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(id_col)), pa.array(cell), pa.array(angle), vectors, batch.column(batch.schema.get_field_index("label"))], [id_col, "cell", "angle", "embedding", "label"])
            yield out.filter(pa.array(cell >= 0))

    index = VectorIndex(spark, path, id_col, rows.schema[id_col].dataType.simpleString(), rows.schema["embedding"].dataType.simpleString())
    placed = held.mapInArrow(work, index.schema)
    placed.hint("rebalance", "label", "cell").sortWithinPartitions("label", "cell", "angle").write.partitionBy("label").parquet(f"{path}/rows")
    seen = {r["cell"]: r for r in index.rows().groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")).collect()}
    table = [(first + n, label, dim, p.tolist(), seen[first + n]["rows"], seen[first + n]["low"], seen[first + n]["high"]) for (label, dim), (first, known) in fitted.items() for n, p in enumerate(known) if first + n in seen]
    spark.createDataFrame(table, "cell int, label string, dim int, pivot array<double>, rows long, low double, high double").coalesce(1).write.parquet(f"{path}/cells")
    return index


def _units(vectors: list | np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The sound ones of some vectors, or of their components in a row, of length one, and which those are."""
    matrix = np.array(vectors, float).reshape(-1, dim)
    with np.errstate(all="ignore"):
        matrix = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    sound = np.isfinite(matrix).all(axis=1)
    return matrix[sound], sound


def _fit(units: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Pivots for a sample: each far from those before it by a weighted draw, then moved to the means of what is nearest."""
    if not len(units):
        return np.eye(1, units.shape[1])
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(units)))]
    far = 1 - units @ units[chosen[0]]
    while len(chosen) < n and (far := np.maximum(far, 0)).sum() > 1e-9:
        chosen.append(int(rng.choice(len(units), p=far / far.sum())))
        far = np.minimum(far, 1 - units @ units[chosen[-1]])
    found = units[chosen]
    for _ in range(rounds):
        near = (units @ found.T).argmax(axis=1)
        total = np.zeros_like(found)
        np.add.at(total, near, units)
        size = np.linalg.norm(total, axis=1)
        found = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], found)
    return found
