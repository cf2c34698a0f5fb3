"""Structured Streaming forms of the incremental steps: files found, statuses set, and counts of progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import records
from ..store import Store, next_seq
from ..workspace import now

FOUND = "project_id string, path string"
CLICKS = "id string, at timestamp, status string"


def found_files(spark: SparkSession, folder: str) -> DataFrame:
    """Listings of found files (project_id, path) that arrive in a folder as JSON lines."""
    return spark.readStream.schema(FOUND).json(folder)


def ingest(found: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Insert-if-absent of a stream of found files. A batch that runs again inserts nothing twice, for ids come from project and path."""

    def take(batch: DataFrame, _: int) -> None:
        new = records.insert_if_absent(records.supported(batch), store.known(), now()).where("is_new")
        store.append("photos", new)

    return found.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clicks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(CLICKS).json(folder)


def apply_statuses(stream: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Each batch's last status of every photo goes to the log; the order of batches is the order of the log."""

    def take(batch: DataFrame, _: int) -> None:
        last = records.latest(batch.where(F.col("status").isin(*records.STATUSES)), ["id"], ["at", "status"], ["status"])
        known = store.known().select("id", "project_id").distinct()
        store.append("statuses", last.join(known, "id").withColumn("seq", F.lit(next_seq())))

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_counts(stream: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """(window, status, n) of clicks by event time; clicks later than ``late`` are left out, and a window comes out when it is over."""
    return stream.withWatermark("at", late).groupBy(F.window("at", window), "status").agg(F.count("*").alias("n"))
