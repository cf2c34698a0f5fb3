"""Reading and changing stored records: latest-wins logs, results of analysis, cascades, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.photo import is_supported, photo_id
from ..schema import ANALYSIS, STATUSES
from .ordinal import ordinal


def supported(files: DataFrame, path: str = "path") -> DataFrame:
    return files.where(is_supported(F.col(path)))


def insert_if_absent(found: DataFrame, existing: DataFrame, now: str) -> DataFrame:
    """(id, project_id, path, status, created_at, is_new): each found (project_id, path) as stored after the insert.

    Paths that are stored already keep their status and time; the others are new, pending and created ``now``.
    """
    wanted = found.select("project_id", "path").distinct().withColumn("id", photo_id(F.col("project_id"), F.col("path")))
    old = existing.select("id", F.col("status").alias("s"), F.col("created_at").alias("c")).distinct()
    return wanted.join(old, "id", "left").select(
        "id", "project_id", "path", F.coalesce("s", F.lit("pending")).alias("status"), F.coalesce("c", F.lit(now)).alias("created_at"), F.col("c").isNull().alias("is_new"))


def latest(log: DataFrame, key: list[str], seq: list[str], values: list[str]) -> DataFrame:
    """The values of each key's last entry by ``seq``. An aggregate, not a window: partial results merge before the shuffle."""
    return log.groupBy(*key).agg(F.max_by(F.struct(*values), F.struct(*seq)).alias("v")).select(*key, *[F.col(f"v.{v}").alias(v) for v in values])


def with_status(photos: DataFrame, log: DataFrame) -> DataFrame:
    """Photos with the last valid status of a log (id, seq, status); entries of unknown photos or statuses change nothing."""
    last = latest(log.where(F.col("status").isin(*STATUSES)), ["id"], ["seq"], ["status"]).withColumnRenamed("status", "__s")
    return photos.join(last, "id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s")


def with_analysis(photos: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Photos with outcomes (id, ok, the ANALYSIS columns, error), at most one a photo, applied.

    Success sets all analysis columns and clears the error; failure sets state and error and leaves the columns.
    """
    renamed = outcomes.select("id", F.col("ok").alias("__ok"), F.col("error").alias("__error"), *[F.col(c).alias(f"__{c}") for c in ANALYSIS])
    ok, tried = F.col("__ok"), F.col("__ok").isNotNull()
    changed = {c: F.when(ok, F.col(f"__{c}")).otherwise(F.col(c)) for c in ANALYSIS}
    changed["analysis_state"] = F.when(ok, "done").when(tried, "failed").otherwise(F.col("analysis_state"))
    changed["analysis_error"] = F.when(ok, F.lit(None).cast("string")).when(tried, F.col("__error")).otherwise(F.col("analysis_error"))
    return photos.join(renamed, "id", "left").withColumns(changed).select(*photos.columns)


def cascade(deleted: DataFrame, projects: DataFrame, photos: DataFrame, groups: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the projects of ``deleted`` (id) and all that belongs to them."""
    gone = deleted.select(F.col("id").alias("project_id"))
    lost_groups = groups.join(gone, "project_id", "left_semi").select(F.col("id").alias("group_id"))
    lost_photos = photos.join(gone, "project_id", "left_semi").select(F.col("id").alias("photo_id"))
    return {
        "projects": projects.join(deleted, "id", "left_anti"),
        "photos": photos.join(gone, "project_id", "left_anti"),
        "similar_groups": groups.join(gone, "project_id", "left_anti"),
        "group_members": members.join(lost_groups, "group_id", "left_anti").join(lost_photos, "photo_id", "left_anti"),
    }


def project_list(projects: DataFrame, photos: DataFrame) -> DataFrame:
    """(pos, id, name, created_at, last_opened_at, photo_count): last opened first, never opened last, then the newest, then by id.

    Photos are counted before they meet the projects, so a project of very many photos costs one row in the join.
    """
    counts = photos.select("id", "project_id").distinct().groupBy(F.col("project_id").alias("p")).agg(F.count("*").alias("n"))
    rows = projects.join(counts, F.col("id") == F.col("p"), "left").select("id", "name", "created_at", "last_opened_at", F.coalesce("n", F.lit(0)).alias("photo_count"))
    return ordinal(rows, [], [F.desc_nulls_last("last_opened_at"), F.desc("created_at"), F.asc("id")], "pos").select("pos", "id", "name", "created_at", "last_opened_at", "photo_count")


def analysis_summary(photos: DataFrame) -> DataFrame:
    """(project_id, analyzed, failed, pending) of the different photos of each project."""
    state = F.col("analysis_state")
    rows = photos.select("id", "project_id", "analysis_state").distinct()
    return rows.groupBy("project_id").agg(F.count_if(state == "done").alias("analyzed"), F.count_if(state == "failed").alias("failed"), F.count_if(state == "pending").alias("pending"))


def group_summary(groups: DataFrame, members: DataFrame, method: str) -> DataFrame:
    """(project_id, groups, grouped_photos): a method's groups that have members, and how many memberships they hold."""
    sizes = members.distinct().groupBy("group_id").agg(F.count("*").alias("n"))
    of_method = groups.where(F.col("method") == method).select(F.col("id").alias("group_id"), "project_id").distinct()
    return of_method.join(sizes, "group_id").groupBy("project_id").agg(F.count("*").alias("groups"), F.sum("n").alias("grouped_photos"))
