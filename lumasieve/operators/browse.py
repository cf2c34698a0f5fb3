"""The browse model: grouped and ungrouped photos of the projects in display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.photo import file_name, is_heic, quality_badges
from ..runtime import Stash
from .ordinal import ordinal
from .similarity import METHOD


def _score() -> Column:
    """The score to show and to sort by: NaN is no score."""
    return F.when(~F.isnan("blur_score"), F.col("blur_score")).alias("blur_score")


def photo_order() -> list[Column]:
    """Time first, nulls last; then the sharper photo, nulls last; then the id."""
    return [F.asc_nulls_last("shot_at"), F.desc_nulls_last("blur_score"), F.asc("photo_id")]


def once(photos: DataFrame) -> DataFrame:
    """Photos without the rows that repeat another in full."""
    return photos.distinct()


def grouped(members: DataFrame, photos: DataFrame, groups: DataFrame, method: str = METHOD) -> DataFrame:
    """(project_id, group_id, photo_id, shot_at, blur_score): members of a method's groups with their photos."""
    of_method = groups.where(F.col("method") == method).select(F.col("id").alias("group_id"), "project_id").distinct()
    shown = once(photos.select(F.col("id").alias("photo_id"), "shot_at", _score()))
    return members.select("group_id", "photo_id").distinct().join(shown, "photo_id").join(of_method, "group_id").select("project_id", "group_id", "photo_id", "shot_at", "blur_score")


def browse_grouped(members: DataFrame, photos: DataFrame, groups: DataFrame, method: str = METHOD) -> DataFrame:
    """(project_id, group_pos, pos, group_id, photo_id, shot_at, blur_score): a project's groups by their earliest capture (none last), then id;
    in each group photos by capture time (none last), sharpness from high to low (none last) and id. Times compare as texts; a score that is NaN
    is none. The joined rows are written once, as the groups' positions and the photos' both need them."""
    rows = Stash(photos.sparkSession, "browse").put(grouped(members, photos, groups, method))
    first = rows.groupBy("project_id", "group_id").agg(F.min("shot_at").alias("earliest"))
    placed = ordinal(first, ["project_id"], [F.asc_nulls_last("earliest"), F.asc("group_id")], "group_pos")
    inside = ordinal(rows, ["group_id"], photo_order(), "pos")
    return inside.join(placed.select("group_id", "group_pos"), "group_id").select("project_id", "group_pos", "pos", "group_id", "photo_id", "shot_at", "blur_score")


def ungrouped(members: DataFrame, photos: DataFrame, groups: DataFrame, method: str = METHOD) -> DataFrame:
    """Photos in no group of the method; one in groups of other methods only is among them."""
    inside = members.join(groups.where(F.col("method") == method).select(F.col("id").alias("group_id")), "group_id", "left_semi").select(F.col("photo_id").alias("id"))
    shown = once(photos.select("id", "project_id", "shot_at", _score()))
    return shown.join(inside, "id", "left_anti").withColumnRenamed("id", "photo_id")


def browse_ungrouped(members: DataFrame, photos: DataFrame, groups: DataFrame, method: str = METHOD) -> DataFrame:
    """(project_id, pos, photo_id, shot_at, blur_score) of the ungrouped photos in the order of photo_order."""
    return ordinal(ungrouped(members, photos, groups, method), ["project_id"], photo_order(), "pos").select("project_id", "pos", "photo_id", "shot_at", "blur_score")


def browse_model(members: DataFrame, photos: DataFrame, groups: DataFrame, method: str = METHOD) -> DataFrame:
    """The nested form for one project's display: (project_id, group_pos, group_id, photos), a list of ids in order. A group must fit a row."""
    flat = browse_grouped(members, photos, groups, method)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "photo_id"))), lambda x: x["photo_id"])
    return flat.groupBy("project_id", "group_pos", "group_id").agg(listed.alias("photos"))


def compare_next(members: DataFrame, photos: DataFrame, groups: DataFrame, method: str = METHOD) -> DataFrame:
    """(group_id, photo_id, next_id): the photo after each in its group, the first one after the last."""
    rows = browse_grouped(members, photos, groups, method).select("group_id", "pos", "photo_id")
    size = rows.groupBy("group_id").agg(F.max("pos").alias("n"))
    after = rows.select("group_id", F.col("pos").alias("next_pos"), F.col("photo_id").alias("next_id"))
    wanted = rows.join(size, "group_id").withColumn("next_pos", F.col("pos") % F.col("n") + 1)
    return wanted.join(after, ["group_id", "next_pos"]).select("group_id", "photo_id", "next_id")


def photo_labels(photos: DataFrame) -> DataFrame:
    """(id, name, heic, badges): what a photo is shown with; badges as words joined by commas."""
    badges = F.array_join(quality_badges(F.col("is_blurry"), F.col("exposure_flag")), ",")
    return photos.select("id", file_name(F.col("path")).alias("name"), is_heic(F.col("path")).alias("heic"), badges.alias("badges"))


def partition_check(members: DataFrame, photos: DataFrame, groups: DataFrame, method: str = METHOD) -> DataFrame:
    """(project_id, n_photos, n_grouped, n_ungrouped, n_both): grouped and ungrouped photos part a project's photos."""
    of_method = groups.where(F.col("method") == method).select(F.col("id").alias("group_id"))
    inside = members.join(of_method, "group_id", "left_semi").select(F.col("photo_id").alias("id")).distinct().withColumn("g", F.lit(1))
    outside = ungrouped(members, photos, groups, method).select(F.col("photo_id").alias("id")).distinct().withColumn("u", F.lit(1))
    every = photos.select("id", "project_id").distinct().join(inside, "id", "left").join(outside, "id", "left")
    return every.groupBy("project_id").agg(
        F.count("*").alias("n_photos"), F.count("g").alias("n_grouped"), F.count("u").alias("n_ungrouped"), F.count(F.expr("g + u")).alias("n_both"))
