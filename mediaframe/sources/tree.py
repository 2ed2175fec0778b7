"""Folder trees as a data source: ``spark.read.format("folder_tree")``.

The driver lists folders, nearest to the root first, until ``tasks`` of them are known; each is a
partition, read by one task: those whose subfolders are known give their own files only, the others the
whole tree below them. Excluded folders are pruned by name before anything in them is listed. Links are followed; a
folder that is one of its own ancestors is not entered again. Names count as they are: a leading
underscore hides nothing, a leading dot only where ``hidden`` is false. What cannot be listed, and names that are not UTF-8,
are left out. Files come out in batches while the walk goes on, so a task holds a stack of folders and no list of files.

The root is on a file system that all executors share.
"""

from __future__ import annotations

import json
import os
import stat
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, size long, mtime timestamp, created timestamp"
TASKS = 256
BATCH = 8192


def entries(folder: str) -> Iterator[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            yield from found
    except OSError:
        return


class Rules:
    """Which folders a walk enters and which files it gives, by name."""

    def __init__(self, names: list[str], suffixes: list[str], hidden: bool):
        self.names, self.suffixes, self.hidden = frozenset(names), tuple(s for s in suffixes if s), hidden

    def enters(self, name: str) -> bool:
        return (self.hidden or not name.startswith(".")) and name not in self.names and not (self.suffixes and name.endswith(self.suffixes))

    def gives(self, name: str) -> bool:
        return self.hidden or not name.startswith(".")


def identity(folder: str) -> tuple[int, int] | None:
    try:
        s = os.stat(folder)
    except OSError:
        return None
    return s.st_dev, s.st_ino


def subfolders(folder: str, above: tuple, rules: Rules) -> Iterator[tuple[str, tuple]]:
    """Folders to enter directly below, each with the identities of itself and all above it."""
    for e in entries(folder):
        try:
            if rules.enters(e.name) and e.is_dir() and (own := identity(e.path)) and own not in above:
                yield e.path, (*above, own)
        except OSError:
            continue


def utf8(name: str) -> bool:
    try:
        name.encode()
    except UnicodeEncodeError:
        return False
    return True


def own_files(folder: str, rules: Rules) -> Iterator[tuple[str, int, int, int]]:
    """Path, size, and the times of change and creation in microseconds."""
    for e in entries(folder):
        try:
            if rules.gives(e.name) and utf8(e.path) and e.is_file():
                s = e.stat()
                if stat.S_ISREG(s.st_mode):
                    yield e.path, s.st_size, s.st_mtime_ns // 1000, int(getattr(s, "st_birthtime", s.st_ctime) * 1e6)
        except OSError:
            continue


class Folder(InputPartition):
    def __init__(self, path: str, above: tuple, deep: bool):
        self.path, self.above, self.deep = path, above, deep


class TreeReader(DataSourceReader):
    def __init__(self, root: str, rules: Rules, tasks: int):
        self.root, self.rules, self.tasks = root, rules, tasks

    def partitions(self) -> list[Folder]:
        own = identity(self.root)
        if own is None or not os.path.isdir(self.root):
            raise ValueError(f"not a folder: {self.root}")
        waiting, listed = deque([(self.root, (own,))]), []
        while waiting and len(waiting) + len(listed) < self.tasks:
            folder, above = waiting.popleft()
            listed.append(Folder(folder, above, False))
            waiting.extend(subfolders(folder, above, self.rules))
        return listed + [Folder(folder, above, True) for folder, above in waiting]

    def read(self, part: Folder) -> Iterator:
        import pyarrow as pa

        kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC"))
        stack, rows = [(part.path, part.above)], []

        def batch():
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()).cast(k) if i else pa.array(c, k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True))], names=["path", "size", "mtime", "created"])

        while stack:
            folder, above = stack.pop()
            for row in own_files(folder, self.rules):
                rows.append(row)
                if len(rows) >= BATCH:
                    yield batch()
                    rows.clear()
            if part.deep:
                stack.extend(subfolders(folder, above, self.rules))
        if rows:
            yield batch()


class FolderTree(DataSource):
    """Options: path; names, suffixes (JSON lists of folder names and endings never entered); hidden (true by default); tasks."""

    @classmethod
    def name(cls) -> str:
        return "folder_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        o = self.options
        rules = Rules(json.loads(o.get("names", "[]")), json.loads(o.get("suffixes", "[]")), o.get("hidden", "true").lower() == "true")
        return TreeReader(o["path"].removeprefix("file://").rstrip("/") or "/", rules, int(o.get("tasks", TASKS)))


def files(spark: SparkSession, root: str, names: tuple[str, ...] = (), suffixes: tuple[str, ...] = (), hidden: bool = True, tasks: int = TASKS) -> DataFrame:
    """path, size, mtime, created of every file below root.

    A root in another store than a shared file system is listed by Spark's own reader: that one leaves out names that begin
    with an underscore or a dot, lists before it filters, and knows no time of creation.
    """
    if "://" in root and not root.startswith("file://"):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.lit(None).cast("timestamp").alias("created"))
    spark.dataSource.register(FolderTree)
    return spark.read.format("folder_tree").option("names", json.dumps(names)).option("suffixes", json.dumps(suffixes)).option("hidden", str(hidden).lower()).option("tasks", tasks).load(root)
