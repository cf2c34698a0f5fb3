"""Session helpers shared by all operators: table access and durable cut points."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for cut points, as the cluster names it in spark.checkpoint.dir.

    Only a local session that names none gets a folder of its own; on a cluster a missing setting is an
    error, because a machine-local folder would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lumasieve-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lumasieve_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lumasieve-code-"), f"lumasieve-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    z.write(whole, os.path.relpath(whole, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._lumasieve_shipped = True


def _remove(spark: SparkSession, *paths: str) -> None:
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


_local = threading.local()  # a scratch holds what its own thread makes


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Within it, operators' intermediate tables live; at its end they are deleted. What is to stay must be written or collected by then."""
    outer, mine = getattr(_local, "tables", None), []
    _local.tables = mine
    try:
        yield
    finally:
        _local.tables = outer
        _remove(spark, *mine)


class Stash:
    """Tables written to the shared folder in order to cut lineage.

    A written table survives the loss of executors. ``drop`` frees the tables of steps that are over, so
    that an iterative operator holds only the last of them on disk. All are deleted at the end of the innermost
    ``scratch`` they were made in, else when the driver ends, as results read them until then.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        tables = getattr(_local, "tables", None)
        if tables is not None:
            tables.append(self.root)
        else:
            at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
            fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.mkdirs(at)  # only what exists can be marked
            fs.deleteOnExit(at)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count:04d}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._stash_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        _remove(self.spark, *[df._stash_path for df in frames])
