"""Approximate nearest neighbours: an inverted file with product-quantised residuals and exact reranking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vectors import matrix, usable

#: Vectors of a shard and queries of a block, about, which one task holds.
SHARD_ROWS, QUERY_ROWS = 8192, 8192


@dataclass
class Index:
    """Coarse centroids (lists, dim) and codebooks (subspaces, 256, dim / subspaces)."""

    centroids: np.ndarray
    books: np.ndarray
    dim: int

    def padded(self, m: np.ndarray) -> np.ndarray:
        return np.pad(m, ((0, 0), (0, self.centroids.shape[1] - self.dim)))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        live = np.flatnonzero(count)
        centres[live] = np.add.reduceat(x[order], (np.cumsum(count) - count)[live], axis=0) / count[live, None]
        if len(live) < k:
            centres[count == 0] = x[rng.choice(len(x), k - len(live))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([((centres**2).sum(1)[None] - 2 * x[k : k + 4096] @ centres.T).argmin(1) for k in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def fit(sample: np.ndarray, lists: int = 64, subspaces: int = 16, seed: int = 5) -> Index:
    """Train centroids and codebooks by k-means on a sample (of bounded size)."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    x = np.pad(sample, ((0, 0), (0, -dim % subspaces))).astype(np.float32)
    centres = _kmeans(x, lists, rng)
    rest = (x - centres[_nearest(x, centres)]).reshape(len(x), subspaces, -1)
    return Index(centres, np.stack([_kmeans(np.ascontiguousarray(rest[:, m]), 256, rng, 5) for m in range(subspaces)]), dim)


def search_shard(index: Index, ids: np.ndarray, base: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, probes: int, rerank: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, exact inner product) of each query's k nearest found in this shard, itself left out.

    Per list, the queries that probe it sum table entries of their own subvectors over the codes
    of its residuals. All candidates no more than `margin` (times the query's length) under the
    `rerank`-th of the approximate values are computed again in double precision.
    """
    x, q = index.padded(base).astype(np.float32), index.padded(queries).astype(np.float32)
    own = _nearest(x, index.centroids)
    order = np.lexsort((ids, own))
    ids, base, x, own = ids[order], base[order], x[order], own[order]
    subspaces, _, width = index.books.shape
    rest = (x - index.centroids[own]).reshape(len(x), subspaces, width)
    codes = np.stack([_nearest(np.ascontiguousarray(rest[:, m]), index.books[m]) for m in range(subspaces)], 1)
    edges = np.searchsorted(own, np.arange(len(index.centroids) + 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        near = part @ index.centroids.T
        probed = np.zeros(near.shape, bool)
        np.put_along_axis(probed, np.argpartition(-near, min(probes, near.shape[1]) - 1, axis=1)[:, :probes], True, axis=1)
        tables = np.einsum("qmw,mcw->mqc", part.reshape(len(part), subspaces, width), index.books, optimize=True)
        score = np.full((len(part), len(x)), -np.inf, np.float32)
        for c in np.flatnonzero(np.diff(edges)):
            rows, who = slice(edges[c], edges[c + 1]), np.flatnonzero(probed[:, c])
            if len(who):
                total = np.repeat(near[who, c][:, None], edges[c + 1] - edges[c], axis=1)
                for m in range(subspaces):
                    total += tables[m][np.ix_(who, codes[rows, m])]
                score[who, rows] = total
        deep = min(rerank, len(x))
        cut = -np.partition(-score, deep - 1, axis=1)[:, deep - 1] - margin * np.linalg.norm(part, axis=1)
        for row in range(len(part)):
            found = np.flatnonzero((score[row] >= cut[row]) & (score[row] > -np.inf))
            found = found[ids[found] != query_ids[at + row]]
            exact = base[found] @ queries[at + row]
            best = np.lexsort((ids[found], -exact))[:k]
            out.append((np.full(len(best), query_ids[at + row]), ids[found[best]], exact[best]))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (empty, empty, np.zeros(0))


def dealt(base: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with shard and block: every row of `base` in its shard meets every one of `queries` in its block exactly once."""
    shards, blocks = max(1, -(-base.count() // SHARD_ROWS)), max(1, -(-queries.count() // QUERY_ROWS))
    own = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    held = base.select(own(shards, 0).alias("shard"), each(blocks).alias("block"), "vec_id", "embedding")
    return held, queries.select(each(shards).alias("shard"), own(blocks, 1).alias("block"), "vec_id", "embedding")


def search(base: DataFrame, queries: DataFrame, k: int = 20, sample: int = 20000, lists: int = 64, probes: int = 44, rerank: int = 200, margin: float = 0.01) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `base` of largest inner product found.

    Both have vec_id and embedding. Rows whose vector is null, zero, of another length than most,
    or holds null or non-finite components, and rows without an id, take no part; base rows with
    the query's own id are left out. Ties go to the smaller vec_id. Empty tables give no rows.

    The index is fitted on at most `sample` vectors, those of the smallest hash of vec_id, and
    holds every base row. Base rows are dealt to shards of about 8,192 by a hash, so that a list
    with very many rows is spread over all of them. Queries are dealt to blocks of about 8,192 in
    the same way; each shard meets each block in one task, whose size does not grow with the
    tables, and which returns k rows for each query; a window keeps the first k of a query's
    rows, in each task before the shuffle too. Columns other than the two are not read.
    """
    spark = base.sparkSession
    base, queries = usable(base), usable(queries)
    taken = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    if not len(taken):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = int(taken["embedding"].map(len).mode().iloc[0])
    index = fit(matrix(taken["embedding"][taken["embedding"].map(len) == dim], dim), min(lists, len(taken)))
    base, queries = base.where(F.size("embedding") == dim), queries.where(F.size("embedding") == dim)
    held, asked = dealt(base, queries)

    def find(rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(ask):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        ask = ask.drop_duplicates("vec_id")
        who, which, score = search_shard(index, rows["vec_id"].to_numpy(), matrix(rows["embedding"], dim), ask["vec_id"].to_numpy(), matrix(ask["embedding"], dim), k, probes, rerank, margin)
        return pd.DataFrame({"query_id": who, "vec_id": which, "score": score})

    found = held.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(find, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
