"""Change feeds of a git working copy."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

SCHEMA = "path string, status string"


def parse_diff(output: str) -> list[tuple[str, str]]:
    """(path, A, M or D) of `git diff --name-status`; a rename is a deletion and an addition, a copy an addition."""
    rows: list[tuple[str, str]] = []
    for line in output.splitlines():
        status, *paths = line.rstrip("\n").split("\t")
        kind = status[:1]
        if kind == "R" and len(paths) == 2:
            rows += [(paths[0], "D"), (paths[1], "A")]
        elif kind == "C" and len(paths) == 2:
            rows.append((paths[1], "A"))
        elif paths and kind in "AMD" and kind:
            rows.append((paths[0], kind))
    return rows


def git_changes(spark: SparkSession, folder: str, base: str = "HEAD~1", head: str = "HEAD", documents: bool = False) -> DataFrame:
    """Changed source files, or documents, outside excluded folders. The diff is taken where the driver runs, as the working copy is there."""
    done = subprocess.run(["git", "-C", folder, "-c", "core.quotePath=off", "diff", "--name-status", base, head, "--"], capture_output=True, text=True, timeout=30, check=True)
    rows = spark.createDataFrame(parse_diff(done.stdout), SCHEMA)
    return rows.where((X.is_document("path") if documents else X.language("path").isNotNull()) & ~X.excluded("path"))


def git_pull(folder: str) -> bool:
    """Whether a fast-forward pull brought anything."""
    done = subprocess.run(["git", "-C", folder, "pull", "--ff-only"], capture_output=True, text=True, timeout=60, check=True)
    return "Already up to date." not in done.stdout


def status_counts(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("status") == s).alias(name) for s, name in (("A", "added"), ("M", "modified"), ("D", "deleted"))))
