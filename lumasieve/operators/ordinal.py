"""Positions in an order, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import Stash


def ordinal(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """Add ``out``: each row's position, from 1, within its group by ``order``, which must be total.

    Rows are range-partitioned by group and order and written; a row's position is that in its part of the group, plus the sizes of the
    group's parts before. So a group of any size is split, and the same rows always get the same positions.
    """
    stash = Stash(df.sparkSession, "ordinal")
    keys = [F.col(c) for c in group] + order
    placed = stash.put(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    local = placed.withColumn("__at", F.row_number().over(Window.partitionBy("__part", *group).orderBy(*order)))
    sizes = placed.groupBy("__part", *group).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    named = [F.col(c).alias(f"__{c}") for c in group]
    offsets = sizes.select(F.col("__part").alias("__in"), *named, F.coalesce(before, F.lit(0)).alias("__before"))
    on = (F.col("__part") == F.col("__in")) if not group else (F.col("__part") == F.col("__in")) & _all(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group)
    joined = local.join(offsets, on).withColumn(out, (F.col("__at") + F.col("__before")).cast("bigint"))
    return joined.drop("__part", "__at", "__in", "__before", *[f"__{c}" for c in group])


def _all(conditions) -> Column:
    total = F.lit(True)
    for c in conditions:
        total = total & c
    return total
