"""Near-duplicate embeddings by tiles of int8 products with rigorous error bounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, components
from .vectors import matrix, usable

#: Rows of a block; a tile holds two blocks at most, and products are made in strips of STRIP rows.
BLOCK_ROWS, STRIP = 4096, 512


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, their scale, and the exact length of what rounding took off each row."""
    scale = np.abs(unit).max(axis=1) / 127
    values = np.rint(unit / scale[:, None]).astype(np.int8)
    return values, scale, np.linalg.norm(unit - values * scale[:, None], axis=1)


def tile_links(left: np.ndarray, right: np.ndarray, same: bool, weights: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted links of the rows of `left` and `right`, and a component label for each row of both.

    For unit vectors u, w and their quantised forms U, W, |u.w - U.W| <= |u-U| |w| + |U| |w-W|.
    Products of int8 values are summed in float32, which is exact below 2**24 (dim <= 1040; wider
    vectors use float64). Only pairs whose bound reaches the threshold are computed again in
    double precision; where they fill much of a strip, as one product.
    """
    wide = np.float32 if left.shape[1] <= 1040 else np.float64
    (ql, sl, el), (qr, sr, er) = quantise(left), quantise(right)
    ul, fl, fr = np.linalg.norm(ql * sl[:, None], axis=1), ql.astype(wide), qr.astype(wide)
    counts = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
    labels = np.arange(len(left) + (0 if same else len(right)))
    shift = 0 if same else len(left)
    for at in range(0, len(left), STRIP):
        rows = slice(at, at + STRIP)
        first = at if same else 0  # of one block against itself, the upper half
        bound = (fl[rows] @ fr[first:].T).astype(np.float64) * sl[rows, None] * sr[None, first:]
        bound += el[rows, None] * (1 + 1e-9) + ul[rows, None] * er[None, first:] + 1e-9
        i, j = np.nonzero(bound >= threshold)
        if not len(i):
            continue
        if len(i) > 0.02 * bound.size:
            exact = (left[rows] @ right[first:].T)[i, j]
        else:
            exact = np.concatenate([np.einsum("ij,ij->i", left[rows][i[k : k + 65536]], right[first:][j[k : k + 65536]]) for k in range(0, len(i), 65536)])
        i, j = i[exact >= threshold] + at, j[exact >= threshold] + first
        if same:
            i, j = i[i < j], j[i < j]
        counts[0][:] += np.bincount(i, weights[1][j], minlength=len(left)).astype(np.int64)
        counts[1][:] += np.bincount(j, weights[0][i], minlength=len(right)).astype(np.int64)
        b = j + shift
        while True:  # hook larger labels to smaller ones, and follow them, until the ends of all links agree
            la, lb = labels[i], labels[b]
            if (la == lb).all():
                break
            np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
            while (labels[labels] != labels).any():
                labels = labels[labels]
    return *counts, labels


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, links being pairs of cosine >= threshold.

    Equal vectors are compared once. Vectors that are null, zero or hold null or non-finite
    components, and vectors of a length that no other has, link with nothing and are kept. A null
    id gives a row with null component. Rows that repeat an id are one vector each: they count as
    links of each other if near. Columns other than the two are not read. An empty table gives no rows.

    The distinct vectors are dealt to blocks of about 4,096 by a hash and every pair of blocks is
    one group of one task, so no key is hot; a task returns counts and a forest, never the pairs.
    """
    stage = Stage(vectors.sparkSession, "vectors")
    rows = usable(vectors, id_col, vector)
    kinds = stage.keep(rows.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    blocks = max(1, -(-kinds.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    tiles = kinds.select("vec_id", "embedding", "copies", block.alias("b")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    tiles = tiles.select("vec_id", "embedding", "copies", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))

    def link(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in group.groupby(group["embedding"].map(len)):
            same = part["i"].iloc[0] == part["j"].iloc[0]
            sides = [part] * 2 if same else [part[part["b"] == part["i"]], part[part["b"] == part["j"]]]
            units = [m / np.linalg.norm(m, axis=1)[:, None] for m in (_scaled(matrix(s["embedding"])) for s in (sides[:1] if same else sides) if len(s))]
            if len(units) < (1 if same else 2):
                continue
            weights = [s["copies"].to_numpy() for s in sides]
            left, right, labels = tile_links(units[0], units[-1], same, (weights[0], weights[1]), threshold)
            ids = sides[0]["vec_id"].to_numpy() if same else np.concatenate([s["vec_id"].to_numpy() for s in sides])
            links = left + right if same else np.concatenate([left, right])
            out.append(pd.DataFrame({"vec_id": ids, "links": links, "root": ids[labels]})[links > 0])
        return pd.concat(out) if out else pd.DataFrame({"vec_id": [], "links": [], "root": []}).astype("int64")

    found = stage.keep(tiles.groupBy("i", "j").applyInPandas(link, "vec_id long, links long, root long"))
    groups = components(stage, found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    kinds = kinds.join(links, "vec_id", "left").join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    kinds = kinds.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    linked = rows.join(kinds, "embedding").select("vec_id", "n_links", "component_id")
    rest = _unusable(vectors, id_col, vector)
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component, so that no length overflows or vanishes."""
    return m / np.abs(m).max(axis=1)[:, None]


def _unusable(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) | ~F.exists(vector, lambda x: x.isNotNull() & (x != 0))
    return df.where(F.col(id_col).isNull() | F.col(vector).isNull() | F.coalesce(bad, F.lit(True))).select(F.col(id_col).cast("long").alias("vec_id"))
