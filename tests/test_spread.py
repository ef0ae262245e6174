"""Costly work on each row is dealt out over all cores, however few splits its input has."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import embed
from graphloom.schema import as_nodes
from graphloom.sources import parse, scan


def test_files_of_one_split_are_parsed_by_many_tasks(spark):
    files = spark.range(200).select(F.concat(F.lit("f"), "id", F.lit(".py")).alias("path"), F.lit("def f():\n  pass\n").alias("content")).coalesce(1)
    found = scan.entities(files)
    assert found.count() == 200
    assert found.select(F.spark_partition_id()).distinct().count() > 4


def test_a_file_is_read_once(monkeypatch):
    read = []
    whole = parse.ast.parse
    monkeypatch.setattr(parse.ast, "parse", lambda x: read.append(x) or whole(x))
    assert len(parse.parse_and_check("python", "def f():\n  g()\n")[0]) == 2 and len(read) == 1
    rows, line = parse.parse_and_check("python", "def f():\n  g()\nx = (\n")
    assert len(rows) == 2 and line and len(read) == 2


def test_long_files_come_in_runs_of_batches(spark):
    many = "".join(f"def f{i}():\n  pass\n" for i in range(parse.RUN + 10))
    files = spark.createDataFrame([("a.py", many), ("b.py", "x = 1\n"), ("c.py", ""), ("d.txt", "x"), ("e.py", None)], "path string, content string")
    found = scan.entities(files)
    assert found.count() == parse.RUN + 10 and found.where("broken is not null").count() == 0


def test_each_text_is_encoded_once_and_by_many_tasks(spark):
    nodes = as_nodes(spark.range(300).select(F.concat(F.lit("Function:"), "id").alias("uid"), F.lit("Function").alias("label"), F.concat(F.lit("name"), "id").alias("name")).coalesce(1))
    found = embed.embed(nodes, dim=8).where("embedding is not null").select("uid", F.size("embedding").alias("n"))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert found.count() == 300
    assert found.select(F.spark_partition_id()).distinct().count() > 4


def test_words_are_hashed_as_one_by_one():
    def plain(text, dim):
        out = np.zeros(dim)
        for word in embed._WORD.findall(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text)):
            w = f"<{word.lower()}>"
            for gram in (w, *(w[i : i + 3] for i in range(len(w) - 2))):
                h = zlib.crc32(gram.encode())
                out[h % dim] += 1.0 if h >> 31 else -1.0
        size = np.linalg.norm(out)
        return (out / size if size else out).astype(np.float32).tolist()

    for text in ("", "a", "the cat the cat THE catDog snake_case 12 größe " * 50, "ab12Cd ef"):
        assert embed.hashed(text, 64) == plain(text, 64)
