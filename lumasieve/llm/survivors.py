"""One surviving record per group of duplicates by skyline selection.

A member is dominated if another one of its group is at least as good in trust, completeness and recency, and better in one. The undominated members
are the group's skyline, its layer 0; a dominated one lies a layer below the deepest of those that dominate it. The survivor is the first member of
layer 0 by a lexicographic policy. A field that it should carry is filled from the first member by the field's own policy, down the layers, past
those whose members lack the field.

Two stages keep a group of any size out of one task's memory. Being undominated in a part of a group is necessary for being so in the whole, so
skylines are first taken among the members of a group that lie in one partition of the join with the photos, a hash of the photo, once among all and
once among the holders of each field. These candidates, a few from each part, then pass by in the order of trust: a stream in which a group's state is
the best recency by layer and completeness, so memory grows with the number of layers and not with that of members.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ids import pack_id, unpack_id
from ..operators.instants import created_micros, shot_micros, with_zones
from ..runtime import ship
from .cutoffs import usable_score

FLAGS = ("normal", "over", "under")
COMPLETE = 5  # the number of fields that completeness counts
_NEVER = -(1 << 63)


def skyline(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are undominated among all of their key, or among those that have a score, or among those that have a flag.

    rows: done, normal (0 or 1), score (null if none), complete (0 to COMPLETE), recent (whole number), has_flag.
    Trust compares done, normal and score in turn, no score being lowest; the field score compares by done and score, the field
    flag by recency. Equal rows don't dominate each other.
    """
    trust = Window.partitionBy(*keys).orderBy(F.desc("done"), F.desc("normal"), F.desc_nulls_last("score"))
    whole = Window.partitionBy(*keys)
    ranked = rows.withColumn("__trust", F.dense_rank().over(trust))
    by_trust = Window.partitionBy(*keys).orderBy("__trust")
    at_least, above = by_trust.rangeBetween(Window.unboundedPreceding, 0), by_trust.rangeBetween(Window.unboundedPreceding, -1)
    recent_of = lambda c: F.max(F.when(F.col("complete") >= c, F.col("recent")))
    levels = range(COMPLETE + 2)
    ranked = ranked.withColumns({
        "__ge": F.array(*[F.coalesce(recent_of(c).over(at_least), F.lit(_NEVER)) if c <= COMPLETE else F.lit(_NEVER) for c in levels]),
        "__gt": F.array(*[recent_of(c).over(above) for c in levels[:-1]]),
        "__done": F.max(F.when(F.col("done") == 1, F.col("score"))).over(whole),
        "__rest": F.max(F.when(F.col("done") == 0, F.col("score"))).over(whole),
        "__flag": F.max(F.when(F.col("has_flag"), F.col("recent"))).over(whole),
    })
    r, ge = F.col("recent"), lambda shift: F.get("__ge", F.col("complete") + shift)
    fuller = (F.col("complete") < COMPLETE) & (ge(1) >= r) & (ge(1) > _NEVER)
    main = ~((ge(0) > r) | fuller | F.coalesce(F.get("__gt", F.col("complete")) >= r, F.lit(False)))
    best = F.when(F.col("done") == 1, F.col("score") == F.col("__done")).otherwise(
        (F.col("score") == F.col("__rest")) & F.coalesce(F.col("score") > F.col("__done"), F.lit(True)))
    kept = ranked.withColumns({
        "in_main": main, "in_score": F.coalesce(best, F.lit(False)), "in_flag": F.col("has_flag") & F.coalesce(r == F.col("__flag"), F.lit(False)),
    })
    return kept.where("in_main or in_score or in_flag").drop("__trust", "__ge", "__gt", "__done", "__rest", "__flag")


class Layers:
    """Numbers the dominance layers of one group, whose members come by trust, completeness and recency, all from high to low."""

    def __init__(self):
        self.best: list[list[int]] = []  # by layer, then by completeness: the latest of the members that are at least that complete
        self.last, self.layer = None, 0

    def place(self, trust: tuple, complete: int, recent: int) -> int:
        """The layer of the next member. Whoever dominates it came before, and equal members share a layer."""
        if (trust, complete, recent) != self.last:
            low, high = 0, len(self.best)
            while low < high:  # a layer that dominates a member lies below others that do
                mid = (low + high) // 2
                if self.best[mid][complete] >= recent:
                    low = mid + 1
                else:
                    high = mid
            if low == len(self.best):
                self.best.append([_NEVER - 1] * (COMPLETE + 1))
            row = self.best[low]
            for c in range(complete + 1):
                row[c] = max(row[c], recent)
            self.last, self.layer = (trust, complete, recent), low
        return self.layer


def layers(candidates: DataFrame) -> DataFrame:
    """The candidates (g, done, normal, score, complete, recent, and others) with ``layer``, their dominance layer among the group's candidates.

    Layer 0 is the skyline of the whole group, if the candidates include it; a deeper layer counts candidates only.
    """
    ship(candidates.sparkSession)

    def number(batches):
        group, state = None, Layers()
        for b in batches:
            out = []
            for g, done, normal, score, complete, recent in zip(*(b[c].to_pylist() for c in ("g", "done", "normal", "score", "complete", "recent"))):
                if g != group:
                    group, state = g, Layers()
                out.append(state.place((done, normal, score), complete, recent))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "layer"])

    order = ["g", F.desc("done"), F.desc("normal"), F.desc_nulls_last("score"), F.desc("complete"), F.desc("recent")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return candidates.repartition("g").sortWithinPartitions(*order).mapInArrow(number, f"{kinds}, layer int")


def layered_members(members: DataFrame, groups: DataFrame, photos: DataFrame, settings: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """The candidates of each group of ``methods`` that has members, with their dominance layers: (g, k, done, normal, score, complete, recent, has_flag,
    layer), ids in packed form. A group's skyline, layer 0, is whole; so are the best holders of score and flag.

    Completeness counts a usable score, an exposure_score, a valid flag, a valid hash and a shot_at instant. A member without photo has none of these. Rows
    without group or photo id are left out. Repeated rows come out again, in the same layer. Empty tables give no row.
    """
    read = photos.where("id is not null").select("id", "project_id", "shot_at", "created_at", "blur_score", "exposure_score", "exposure_flag", "phash", "analysis_state")
    read = created_micros(shot_micros(with_zones(read, settings)))
    flag, score = F.lower(F.btrim("exposure_flag", F.lit(" \t\r\n\f\v\u00a0"))), usable_score(F.col("blur_score")) + F.lit(0.0)  # so that minus zero is zero
    known = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    valid_flag = known(flag.isin(*FLAGS))
    complete = known(score.isNotNull()) + known(F.col("exposure_score").isNotNull()) + valid_flag + known(F.col("phash").rlike("^[0-9a-fA-F]{16}\\z")) + known(F.col("shot_micros").isNotNull())
    facts = read.select(
        pack_id(F.col("id")).alias("k"), score.alias("score"), F.coalesce("created_micros", F.lit(_NEVER)).alias("recent"),
        # four small numbers in one: done, normal, has_flag, complete
        (known(F.col("analysis_state") == "done") * 1000 + known(flag == "normal") * 100 + valid_flag * 10 + complete).cast("short").alias("facts"),
    )
    wanted = groups.where(F.col("method").isin(*methods) & F.col("id").isNotNull()).select(pack_id(F.col("id")).alias("g"))
    pairs = members.where("group_id is not null and photo_id is not null").select(pack_id(F.col("group_id")).alias("g"), pack_id(F.col("photo_id")).alias("k"))
    rows = pairs.join(wanted, "g", "left_semi").join(facts, "k", "left")
    rows = rows.select("g", "k", "score", F.coalesce("recent", F.lit(_NEVER)).alias("recent"), F.coalesce("facts", F.lit(0).cast("short")).alias("facts"), F.spark_partition_id().alias("part"))
    digit = lambda power: (F.floor(F.col("facts") / power) % 10).cast("int")
    rows = rows.withColumns({"done": digit(1000), "normal": digit(100), "has_flag": digit(10) == 1, "complete": digit(1)}).drop("facts")
    return layers(skyline(rows, ["g", "part"]).drop("part", "in_main", "in_score", "in_flag"))


def group_skyline(members: DataFrame, groups: DataFrame, photos: DataFrame, settings: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(group_id, photo_id) of the undominated members of each group, once; see layered_members."""
    first = layered_members(members, groups, photos, settings, methods).where("layer = 0").select("g", "k").distinct()
    return first.select(unpack_id(F.col("g")).alias("group_id"), unpack_id(F.col("k")).alias("photo_id"))


def group_survivors(members: DataFrame, groups: DataFrame, photos: DataFrame, settings: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(group_id, photo_id, blur_from, flag_from, blur_layer, flag_layer) of each group of ``methods`` that has members.

    photo_id: of layer 0, first by state done, completeness, flag normal, usable score (none last), later created_at instant (none last), smaller id.
    blur_from: among members with a usable score, first by state done, score, smaller id. flag_from: among members with a valid flag, first by
    later created_at instant (none last), smaller id. Empty text if there is none. blur_layer and flag_layer tell the layer that either comes from.

    A member without photo can only win by id. Rows without group or photo id are left out; repeated rows count once
    (rows of one photo that differ count as members of their own, all under its id). Empty tables give no row.
    """
    left = layered_members(members, groups, photos, settings, methods).withColumn("id", unpack_id(F.col("k")))
    down = lambda c: (-F.col(c)).alias(c)
    late = F.bitwise_not(F.col("recent")).alias("recent")  # falls as recent rises, without overflow
    lost = F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("score")
    no_score = F.col("score").isNull().alias("no_score")
    first = lambda having, *policy: F.min(F.when(having, F.struct(*policy, "id", "layer")))
    best = left.groupBy("g").agg(
        first(F.col("layer") == 0, down("done"), down("complete"), down("normal"), no_score, lost, late).alias("main"),
        first(F.col("score").isNotNull(), down("done"), lost).alias("blur"),
        first(F.col("has_flag"), late).alias("flag"),
    )
    return best.select(
        unpack_id(F.col("g")).alias("group_id"), F.col("main.id").alias("photo_id"), F.coalesce("blur.id", F.lit("")).alias("blur_from"), F.coalesce("flag.id", F.lit("")).alias("flag_from"),
        F.col("blur.layer").alias("blur_layer"), F.col("flag.layer").alias("flag_layer"))
