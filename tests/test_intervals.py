"""Sweeps over ranges against brute force, in one bin and in many, and a file with very many rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import intervals

RANGES = "file string, start_line long, end_line long, name string, pos int"


def data(seed, files=4, ranges=60, points=80, wide=300):
    rnd = random.Random(seed)
    held = []
    for f in range(files):
        for k in range(ranges):
            s = rnd.randint(0, wide)
            held.append((f"f{f}", s, s + int(rnd.expovariate(1 / rnd.choice((3, 40, 200)))), f"n{k}", k))
    spots = [(f"f{rnd.randrange(files + 1)}", rnd.randint(-5, wide + 250), i) for i in range(points * files)]
    return held, spots


def inside(held, file, x):
    fit = [(e - s, p, n) for f, s, e, n, p in held if f == file is not None and x is not None and s <= x <= e]
    return min(fit)[2] if fit else None


def parent(held, file, a, b):
    fit = [(p, n) for f, s, e, n, p in held if f == file and s <= a and b <= e]
    return max(fit)[1] if fit else None


@pytest.mark.parametrize("rows", [50_000, 8, 1])
def test_innermost_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(intervals, "BIN_ROWS", rows)
    held, spots = data(rows)
    held += [("f0", 5, 5, "twin", 900), ("f0", 5, 5, "twin first", 800), ("f0", 9, 2, "turned", 1), (None, 0, 9, "no file", 1)]
    spots += [("f0", 5, 1), ("f0", 5, 1), (None, 3, 2), ("f0", None, 3)]
    found = intervals.innermost(spark.createDataFrame(spots, "file string, line long, i int"), spark.createDataFrame(held, RANGES), "file", "line")
    assert found.columns == ["file", "line", "i", "inside"]
    assert sorted(map(repr, found.collect())) == sorted(map(repr, _rows(spark, [(*p, inside(held, p[0], p[1])) for p in spots], "file string, line long, i int, inside string")))


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema).collect()


def test_enclosing_equals_brute_force(spark):
    held, spots = data(5)
    items = [(f, x, x + i % 7, i) for f, x, i in spots] + [("f0", None, 3, 1), (None, 1, 2, 2)]
    found = intervals.enclosing(spark.createDataFrame(items, "file string, start_line long, end_line long, i int"), spark.createDataFrame(held, RANGES), "file")
    want = [(*p, None if None in p else parent(held, *p[:3])) for p in items]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_one_file_of_very_many_rows(spark):
    n = 100_000
    ranges = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("start_line"), (F.col("id") + F.col("id") % 1000 * 50).alias("end_line"), F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("int").alias("pos"))
    points = spark.range(n).select(F.lit("f").alias("file"), F.col("id").alias("line"))
    began = time.time()
    found = intervals.innermost(points, ranges, "file", "line")
    assert found.count() == n and found.where("inside is null").count() == 0
    assert {r["line"]: r["inside"] for r in found.where("line in (0, 1, 1001)").collect()} == {0: "n0", 1: "n1", 1001: "n1001"}
    items = points.select("file", F.col("line").alias("start_line"), (F.col("line") + 40).alias("end_line"))
    assert intervals.enclosing(items, ranges, "file").where("parent is not null").count() > n // 2
    assert time.time() - began < 120
