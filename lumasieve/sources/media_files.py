"""A data source that walks folders for media files, whatever their names begin with.

    spark.dataSource.register(MediaFiles)
    spark.read.format("media_files").option("path", "/pictures").load()

Rows: path, size, mtime_ns, error. A file or folder that can't be read is a row with an error and stops nothing. Links are neither followed nor
taken. The uppermost folders are taken apart, breadth first, until there are PARTS partitions: a folder taken apart is one for its own files, each
of its subfolders one with all below it.
"""

from __future__ import annotations

import collections
import os
import stat

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import ship

#: Partitions to aim at; the driver looks into no more folders than that.
PARTS = 256
SCHEMA = "path string, size bigint, mtime_ns bigint, error string"


class Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


def _walk(folder: str, deep: bool):
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError as e:
        yield folder, None, None, f"{type(e).__name__}: {e.strerror}"
        return
    for e in entries:
        try:
            info = e.stat(follow_symlinks=False)
        except OSError as x:
            yield e.path, None, None, f"{type(x).__name__}: {x.strerror}"
            continue
        if stat.S_ISREG(info.st_mode):
            yield e.path.encode("utf-8", "surrogateescape").decode("utf-8", "replace"), info.st_size, info.st_mtime_ns, None
        elif stat.S_ISDIR(info.st_mode) and deep:
            yield from _walk(e.path, True)


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        whole, own = collections.deque([self.root]), []
        while whole and len(whole) + len(own) < PARTS:
            folder = whole.popleft()
            own.append(folder)
            try:
                whole.extend(sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False)))
            except OSError:  # its partition will tell
                pass
        return [Folder(p, False) for p in own] + [Folder(p, True) for p in whole]

    def read(self, partition):
        yield from _walk(partition.path, partition.deep)


class MediaFiles(DataSource):
    @classmethod
    def name(cls):
        return "media_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])


def media_files(spark: SparkSession, root: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaFiles)
    return spark.read.format("media_files").option("path", root).load()


def scan_summary(files: DataFrame) -> DataFrame:
    """(found, skipped): files read, and entries that couldn't be."""
    return files.agg(F.count_if(F.col("error").isNull()).alias("found"), F.count_if(F.col("error").isNotNull()).alias("skipped"))
