"""The N first items of every group by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import pack_id, unpack_id
from .cutoffs import usable_score

SUBGROUPS = 64


def salted_top_n(rows: DataFrame, group: str, salt: Column, order: list[Column], item: list[str], n: int, subgroups: int = SUBGROUPS) -> DataFrame:
    """The first ``n`` different items of each group by ``order``, with their rank in ``rank``.

    Each group is hashed into subgroups, at most n items of each are kept, then the survivors of a group are ranked: the
    second stage sees at most n * subgroups items of any group. ``order`` must be total over different items; rows of one item
    share a rank and come out once. Items go to one subgroup by ``salt``.
    """
    part = rows.withColumn("__sub", F.pmod(F.xxhash64(salt), F.lit(subgroups)).cast("int"))
    first = Window.partitionBy(group, "__sub").orderBy(*order)
    kept = part.withColumn("rank", F.dense_rank().over(first)).where(F.col("rank") <= n).drop("rank", "__sub")
    final = Window.partitionBy(group).orderBy(*order)
    return kept.withColumn("rank", F.dense_rank().over(final)).where(F.col("rank") <= n).dropDuplicates([group, *item])


def top_members(members: DataFrame, photos: DataFrame, n: int = 3, subgroups: int = SUBGROUPS) -> DataFrame:
    """(group_id, photo_id, score, rank): the first n members of each group by usable score from high to low, then id.

    Members without a usable score, or without photo, come last, by id alone. Rows without group or photo id are left out;
    repeated rows count once (should rows of a photo differ, its highest score counts). Empty tables give no row.
    """
    score = usable_score(F.col("blur_score"))
    scored = photos.where(score.isNotNull() & F.col("id").isNotNull()).select(pack_id(F.col("id")).alias("k"), F.col("blur_score").alias("score"))
    scored = scored.groupBy("k").agg(F.max("score").alias("score"))
    pairs = members.where("group_id is not null and photo_id is not null").select(pack_id(F.col("group_id")).alias("g"), pack_id(F.col("photo_id")).alias("k"))
    rows = pairs.join(scored, "k", "left").select("g", unpack_id(F.col("k")).alias("photo_id"), "score")
    best = salted_top_n(rows, "g", F.col("photo_id"), [F.desc_nulls_last("score"), F.asc("photo_id")], ["photo_id"], n, subgroups)
    return best.select(unpack_id(F.col("g")).alias("group_id"), "photo_id", "score", "rank")
