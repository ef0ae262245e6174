"""Which range holds a point or a range: sweeps over the lines of a file, large files in bins."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a bin, about; files with fewer points and ranges are one bin.
BIN_ROWS = 50_000
#: Binary orders of bins: a file has at most 2**LEVELS.
LEVELS = 24
_FAR = 1 << 62


def innermost(points: DataFrame, ranges: DataFrame, key: str, at: str, start: str = "start_line", end: str = "end_line", name: str = "name", order: str = "pos") -> DataFrame:
    """`points` with `inside`: the name of the shortest range of the same key that holds the point, the first of equal ones; null without any.

    Points of one line, and ranges of the same lines, are one row of the sweep. A key with many
    rows is cut into bins of lines. A range is a row of the bins that its ends lie in; the bins
    between them it covers whole, and of all such ranges a bin needs the best alone. These are
    found by binary order: a range is cut into at most two blocks of bins for each power of two,
    each block keeps its best range, and a bin asks the blocks around it. So no range is copied to
    each bin that it covers, and no task holds more than a bin. Null keys and lines are in no range.
    """
    at_, r = F.col(at).cast("long"), [F.col(c).cast("long") for c in (start, end)]
    kind = {f.name: f.dataType for f in ranges.schema.fields}
    spots = points.select(F.col(key).alias("_k"), at_.alias("_x")).where("_k is not null and _x is not null").distinct()
    best = F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n")))
    held = ranges.where(F.col(key).isNotNull() & (r[0] <= r[1])).groupBy(F.col(key).alias("_k"), r[0].alias("_s"), r[1].alias("_e")).agg(best.alias("_b"))
    spots, held = _binned(spots, held)
    ends = held.select("*", F.explode(F.array_distinct(F.array("_first", "_last"))).alias("_bin"))
    rows = ends.select("_k", "_bin", "_s", "_e", (F.col("_e") - F.col("_s")).alias("_size"), "_b")
    rows = rows.unionByName(_covering(spots, held))
    schema = StructType().add("_k", kind[key]).add("_x", "long").add("inside", kind[name])

    def sweep(spots: pa.Table, rows: pa.Table) -> pa.Table:
        x, s, e = spots.column("_x").to_numpy(), rows.column("_s").to_numpy(), rows.column("_e").to_numpy()
        first = rows.column("_b").combine_chunks().field(0)
        rank = np.lexsort((np.argsort(pc.sort_indices(first).to_numpy(), kind="stable"), rows.column("_size").to_numpy()))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        found = np.full(len(x), -1, np.int64)
        todo, n, open_ = np.argsort(s, kind="stable"), 0, []
        for k in np.argsort(x, kind="stable").tolist():
            while n < len(todo) and s[todo[n]] <= x[k]:
                heapq.heappush(open_, place[todo[n]])
                n += 1
            while open_ and e[rank[open_[0]]] < x[k]:
                heapq.heappop(open_)
            if open_:
                found[k] = rank[open_[0]]
        names = rows.column("_b").combine_chunks().field(1).take(pa.array(found, mask=found < 0))
        return pa.table({"_k": spots.column("_k"), "_x": spots.column("_x"), "inside": names})

    met = spots.groupBy("_k", "_bin").cogroup(rows.groupBy("_k", "_bin")).applyInArrow(sweep, schema)
    return points.join(met, [F.col(key) == F.col("_k"), at_ == F.col("_x")], "left").drop("_k", "_x")


def _binned(spots: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with their bin, and ranges with the bins that their ends lie in."""
    lines = spots.select("_k", F.col("_x").alias("lo"), F.col("_x").alias("hi")).unionByName(held.select("_k", F.col("_s").alias("lo"), F.col("_e").alias("hi")))
    wide = lines.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("_lo"), F.max("hi").alias("hi"))
    bins = F.least(F.ceil(F.col("n") / F.lit(BIN_ROWS)), F.lit(1 << LEVELS))
    wide = wide.select("_k", "_lo", F.ceil((F.col("hi") - F.col("_lo") + 1) / bins).cast("long").alias("_w"))
    bin_ = lambda c: F.floor((F.col(c) - F.col("_lo")) / F.col("_w")).cast("long")
    return spots.join(wide, "_k").select("_k", "_x", bin_("_x").alias("_bin")), held.join(wide, "_k").select("_k", "_s", "_e", "_b", bin_("_s").alias("_first"), bin_("_e").alias("_last"))


def _covering(spots: DataFrame, held: DataFrame) -> DataFrame:
    """For each bin with points the best range that covers it whole and has no end in it, as a row of that bin."""
    parts = F.expr(
        f"""flatten(transform(sequence(0, {LEVELS}), j -> filter(array(
          struct(j AS level, shiftright(_first + shiftleft(1L, j), j) AS block, shiftright(_first + shiftleft(1L, j), j) % 2 = 1 AS own),
          struct(j AS level, shiftright(_last, j) - 1 AS block, shiftright(_last, j) % 2 = 1 AS own)
        ), x -> x.own AND shiftright(_first + shiftleft(1L, j), j) < shiftright(_last, j))))"""
    )
    size = (F.col("_e") - F.col("_s")).alias("size")
    of_block = held.where("_last > _first + 1").select("_k", F.struct(size, F.col("_b").alias("b")).alias("best"), F.explode(F.array_distinct(parts)).alias("p"))
    of_block = of_block.groupBy("_k", F.col("p.level").alias("level"), F.col("p.block").alias("block")).agg(F.min("best").alias("best"))
    asked = spots.select("_k", "_bin").distinct().select("_k", "_bin", F.posexplode(F.expr(f"transform(sequence(0, {LEVELS}), j -> shiftright(_bin, j))")).alias("level", "block"))
    best = asked.join(of_block, ["_k", "level", "block"]).groupBy("_k", "_bin").agg(F.min("best").alias("best"))
    return best.select("_k", "_bin", F.lit(-_FAR).alias("_s"), F.lit(_FAR).alias("_e"), F.col("best.size").alias("_size"), F.col("best.b").alias("_b"))


def enclosing(items: DataFrame, ranges: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """`items` with `parent`: the name of the last range, in file order, that holds an item's own range; null without any.

    Each file is one group, swept by its start lines, with a tree of the last range by end line:
    n log n in its distinct ranges and items. Null keys and lines are in no range.
    """
    kind = {f.name: f.dataType for f in ranges.schema.fields}
    spots = items.select(F.col(key).alias("_k"), F.col("start_line").cast("long").alias("_s"), F.col("end_line").cast("long").alias("_e")).where("_k is not null and _s is not null and _e is not null").distinct()
    last = F.max(F.struct(F.col(order).alias("o"), F.col("name").alias("n"))).alias("_b")
    held = ranges.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k"), F.col("start_line").cast("long").alias("_s"), F.col("end_line").cast("long").alias("_e")).agg(last).where("_s is not null and _e is not null")
    schema = StructType().add("_k", kind[key]).add("_s", "long").add("_e", "long").add("parent", kind["name"])

    def sweep(spots: pa.Table, rows: pa.Table) -> pa.Table:
        s, e, rs, re_ = (t.column(c).to_numpy() for t in (spots, rows) for c in ("_s", "_e"))
        by_order = pc.sort_indices(rows.column("_b").combine_chunks().field(0)).to_numpy()
        rank = np.empty(len(rs), np.int64)
        rank[by_order] = np.arange(len(rs))
        ends = np.unique(re_)[::-1]  # descending: a prefix of the tree is all ends from some line on
        where = len(ends) - np.searchsorted(ends[::-1], re_)
        upto = len(ends) - np.searchsorted(ends[::-1], e)
        tree, found, n = [-1] * (len(ends) + 1), np.full(len(s), -1, np.int64), 0
        todo = np.argsort(rs, kind="stable")
        for k in np.argsort(s, kind="stable").tolist():
            while n < len(todo) and rs[todo[n]] <= s[k]:
                at, value = int(where[todo[n]]), int(rank[todo[n]])
                while at <= len(ends):
                    tree[at] = max(tree[at], value)
                    at += at & -at
                n += 1
            at, best = int(upto[k]), -1
            while at > 0:
                best = max(best, tree[at])
                at -= at & -at
            found[k] = by_order[best] if best >= 0 else -1
        names = rows.column("_b").combine_chunks().field(1).take(pa.array(found, mask=found < 0))
        return pa.table({"_k": spots.column("_k"), "_s": spots.column("_s"), "_e": spots.column("_e"), "parent": names})

    met = spots.groupBy("_k").cogroup(held.groupBy("_k")).applyInArrow(sweep, schema)
    same = [F.col(key) == F.col("_k"), F.col("start_line") == F.col("_s"), F.col("end_line") == F.col("_e")]
    return items.join(met, same, "left").drop("_k", "_s", "_e")
