"""Commits of a git working copy as a data source: `spark.read.format("git_changes")`, and `readStream` with commits as offsets."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .changes import parse_diff

SCHEMA = "path string, status string, content string, commit string"
#: Fixed value: the name that git gives to a tree without files.
NOTHING = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
#: Changed files that one task reads.
FILES = 200


def _git(folder: str, *args: str, data: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-C", folder, *args], capture_output=True, check=True, timeout=600, input=data).stdout


@dataclass
class Part(InputPartition):
    """Some changed files of a commit."""

    folder: str
    commit: str
    files: list[tuple[str, str]]


def split(folder: str, base: str, head: str, size: int) -> list[Part]:
    """The files that differ between two commits, names and states alone, in parts of `size`."""
    out = _git(folder, "-c", "core.quotePath=off", "diff", "--name-status", base, head, "--").decode("utf-8", "replace")
    rows = sorted({path: status for path, status in parse_diff(out)}.items())
    return [Part(folder, head, rows[k : k + size]) for k in range(0, len(rows), size)]


def read(part: Part) -> Iterator[tuple]:
    """(path, status, content, commit); contents come from git's own store, so the working copy's state does not matter."""
    there = [path for path, status in part.files if status != "D" and "\n" not in path]
    held: dict[str, str] = {}
    if there:
        data = _git(part.folder, "cat-file", "--batch", data="".join(f"{part.commit}:{p}\n" for p in there).encode())
        at = 0
        for path in there:
            end = data.index(b"\n", at)
            head = data[at:end].split(b" ")
            at = end + 1
            if len(head) >= 3 and head[-2] == b"blob":
                size = int(head[-1])
                held[path] = data[at : at + size].decode("utf-8", "replace")
                at += size + 1
            elif len(head) >= 3 and head[-1].isdigit():  # a tree or a submodule's commit
                at += int(head[-1]) + 1
    for path, status in part.files:
        yield path, status, held.get(path), part.commit


class _Options:
    def __init__(self, options: dict[str, str]):
        self.folder = options.get("path") or ""
        if not self.folder:
            raise ValueError("the option path must name a working copy")
        self.base, self.head, self.size = options.get("base", NOTHING), options.get("head", "HEAD"), int(options.get("filesPerTask", FILES))

    def commit(self, name: str) -> str:
        return name if name == NOTHING else _git(self.folder, "rev-parse", "--verify", f"{name}^{{commit}}").decode().strip()


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def partitions(self) -> list[Part]:
        o = self.options
        return split(o.folder, o.commit(o.base), o.commit(o.head), o.size)

    def read(self, partition: Part | None) -> Iterator[tuple]:
        return read(partition) if partition else iter(())  # where no file differs, Spark reads a partition of its own


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = _Options(options)

    def initialOffset(self) -> dict:
        return {"commit": self.options.commit(self.options.base)}

    def latestOffset(self) -> dict:
        return {"commit": self.options.commit(self.options.head)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return split(self.options.folder, start["commit"], end["commit"], self.options.size)

    def read(self, partition: Part | None) -> Iterator[tuple]:
        return read(partition) if partition else iter(())  # where no file differs, Spark reads a partition of its own

    def commit(self, end: dict) -> None:
        """Nothing to give back: commits stay."""


class GitChanges(DataSource):
    """The difference of two commits: options path (a working copy that driver and tasks can reach), base, head and filesPerTask.

    As a stream each batch is the difference between the commit of the last batch and `head` as it
    is then, from `base` on (by default from nothing). An offset is a commit, so a query that
    starts again from its checkpoint goes on from the last commit that it applied. The driver
    learns the names of changed files; their contents are read by tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def load(spark: SparkSession, folder: str, base: str = NOTHING, head: str = "HEAD", stream: bool = False) -> DataFrame:
    """(path, status, content, commit) of all files that differ, of every kind."""
    spark.dataSource.register(GitChanges)
    source = spark.readStream if stream else spark.read
    return source.format("git_changes").option("path", folder).option("base", base).option("head", head).load()
