"""Schemas of the stored tables, their enumerations, and checks of rows from outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .errors import Invalid

SCHEMA_VERSION = 4

# What the enumerated columns may hold, the default first.
STATUSES = ("pending", "keep", "reject")
ANALYSIS_STATES = ("pending", "done", "failed")
EXPOSURE_FLAGS = ("normal", "over", "under")

_s = T.StringType()


def _struct(*required: str, **optional: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, _s, False) for n in required] + [T.StructField(n, t, True) for n, t in optional.items()])


PROJECTS = _struct("id", "name", "created_at", last_opened_at=_s)
PHOTOS = T.StructType([
    *[T.StructField(n, _s, False) for n in ("id", "project_id", "path", "status", "created_at")],
    T.StructField("shot_at", _s), T.StructField("blur_score", T.DoubleType()), T.StructField("is_blurry", T.BooleanType()),
    T.StructField("exposure_score", T.DoubleType()), T.StructField("exposure_flag", _s), T.StructField("phash", _s),
    T.StructField("analysis_state", _s, False), T.StructField("analysis_error", _s),
])
SIMILAR_GROUPS = _struct("id", "project_id", "method", "params")
GROUP_MEMBERS = _struct("group_id", "photo_id")
ANALYSIS = ("shot_at", "blur_score", "is_blurry", "exposure_score", "exposure_flag", "phash")


def degrade(col: Column, known: tuple[str, ...], default: str | None) -> Column:
    """The value if it is a known one, else the default; null counts as unknown."""
    return F.when(col.isin(*known), col).otherwise(F.lit(default))


def degraded(photos: DataFrame) -> DataFrame:
    """Photos as the interface shows them: unknown values of enumerated columns become their defaults."""
    return photos.withColumns({
        "status": degrade(F.col("status"), STATUSES, "pending"),
        "exposure_flag": degrade(F.col("exposure_flag"), EXPOSURE_FLAGS, None),
        "analysis_state": degrade(F.col("analysis_state"), ANALYSIS_STATES, "pending"),
    })


def checked(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows in the columns and types of ``schema``; a missing column or another type is an error, further columns are dropped."""
    for f in schema.fields:
        if f.name not in rows.columns:
            raise Invalid(f"column {f.name} is missing")
        if rows.schema[f.name].dataType != f.dataType:
            raise Invalid(f"column {f.name} must be {f.dataType.simpleString()}, not {rows.schema[f.name].dataType.simpleString()}")
    return rows.select(*schema.fieldNames())


def valid_rows(photos: DataFrame) -> DataFrame:
    """Photos whose enumerated columns hold known values; any other fails the query that writes them."""
    ok = F.col("status").isin(*STATUSES) & F.col("analysis_state").isin(*ANALYSIS_STATES) & (F.col("exposure_flag").isNull() | F.col("exposure_flag").isin(*EXPOSURE_FLAGS))
    return photos.withColumn("id", F.when(F.coalesce(ok, F.lit(False)), F.col("id")).otherwise(F.raise_error(F.lit("a row holds an unknown status, state or flag")).cast("string")))
