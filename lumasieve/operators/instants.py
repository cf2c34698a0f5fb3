"""Instants of the photos' two time columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ids import pack_id, unpack_id
from ..functions.timestamps import instant_micros, zones


def project_zones(spark: SparkSession, settings: DataFrame) -> DataFrame:
    """One row per project: zone_project, zone_name, zone_codes, zone_order. Unknown zone names give null.

    Of several rows of one project the smallest counts; rows without project are left out.
    """
    one = (
        settings.where(F.col("project_id").isNotNull())
        .groupBy(F.col("project_id").alias("zone_project"))
        .agg(F.min(F.struct(F.trim("tz_name").alias("tz"), F.col("date_order").alias("o"))).alias("__s"))
        .select("zone_project", F.col("__s.tz").alias("__tz"), F.col("__s.o").alias("zone_order"))
    )
    known = zones(spark)  # a few hundred rows: bounded by the zone rules, not by the data
    return one.join(F.broadcast(known), F.col("__tz") == known.zone_name, "left").drop("__tz")


def with_zones(photos: DataFrame, settings: DataFrame) -> DataFrame:
    """Photos and their project's zone. A plain left join: it is broadcast only if the settings turn out small,
    and a project with very many photos is split by the adaptive skew join otherwise."""
    zoned = project_zones(photos.sparkSession, settings)
    return photos.join(zoned, photos.project_id == zoned.zone_project, "left").drop("zone_project")


def shot_micros(zoned: DataFrame, out: str = "shot_micros") -> DataFrame:
    """shot_at without zone is local time of the project's cameras."""
    return instant_micros(zoned, "shot_at", out, F.col("zone_name"), F.col("zone_order"), F.col("zone_codes"))


def created_micros(zoned: DataFrame, out: str = "created_micros") -> DataFrame:
    """created_at without zone is UTC; its zone letters are those of the project's zone."""
    utc = F.create_map(*[x for k in ("UTC", "GMT", "Z") for x in (F.lit(k), F.lit(0))])
    return instant_micros(zoned, "created_at", out, F.lit("UTC"), F.col("zone_order"), F.coalesce(F.col("zone_codes"), utc))


def photo_instants(photos: DataFrame, settings: DataFrame) -> DataFrame:
    """(photo_id, field, utc_micros) for each of shot_at and created_at that states an instant.

    Rows without id are no photos. Rows repeated with one id count once; should they differ, the later instant
    counts. A photo without project or without known zone has only instants that need no zone. Nulls, empty and
    unreadable texts give no row; an empty table gives none.
    """
    raw = photos.select("id", "project_id", "shot_at", "created_at").where(F.col("id").isNotNull())
    read = created_micros(shot_micros(with_zones(raw, settings)))
    once = read.groupBy(pack_id(F.col("id")).alias("k")).agg(F.max("shot_micros").alias("shot_at"), F.max("created_micros").alias("created_at"))
    pair = lambda k: F.struct(F.lit(k).alias("field"), F.col(k).alias("utc_micros"))
    long = once.select("k", F.explode(F.array(pair("shot_at"), pair("created_at"))).alias("v"))
    return long.where("v.utc_micros is not null").select(unpack_id(F.col("k")).alias("photo_id"), "v.field", "v.utc_micros")
