"""Near-duplicate photos: pairs of close fingerprints taken close together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import pack_id, unpack_id
from ..operators.instants import shot_micros, with_zones
from ..runtime import Stash, ship
from .vptree import Trunk, near_pairs

RADIUS = 8
WINDOW_MICROS = 600_000_000
SLOT_MICROS = 3 * WINDOW_MICROS
#: Rows of one time slot from which on it is split further, fingerprints of the routing tree's sample, its depth.
SHARD_ROWS, TRUNK_SAMPLE, TRUNK_DEPTH = 100_000, 4096, 6
_KEYS = ["project_id", "slot", "leaf", "i", "j"]


def fingerprints(photos: DataFrame, settings: DataFrame, phash: Column | None = None) -> DataFrame:
    """(project_id, k, h, t): photos with id, project and valid hash; t is null without instant.

    phash: a column that is null or valid keeps all photos with an id instead; h is null where it is.

    The caller filters t only behind a cut: a filter here would be pushed below and evaluate every expression twice.
    """
    kept = photos.where("id is not null")
    if phash is None:
        phash = F.col("phash")
        kept = kept.where(phash.rlike("^[0-9a-fA-F]{16}\\z") & F.col("project_id").isNotNull() & F.col("shot_at").isNotNull())
    read = shot_micros(with_zones(kept.select("id", "project_id", "shot_at", phash.alias("phash")), settings))
    return read.select("project_id", pack_id(F.col("id")).alias("k"), F.conv("phash", 16, -10).cast("bigint").alias("h"), F.col("shot_micros").alias("t"))


def _slots(points: DataFrame) -> DataFrame:
    """Each row at home in its time slot; those that a row of the slot before may reach also visit that one."""
    at = F.expr(f"(t - pmod(t, {SLOT_MICROS}L)) div {SLOT_MICROS}L")
    home, visit = F.struct(at.alias("slot"), F.lit(0).alias("kind")), F.struct((at - 1).alias("slot"), F.lit(1).alias("kind"))
    near = F.pmod(F.col("t"), F.lit(SLOT_MICROS)) < WINDOW_MICROS
    return points.select("*", F.explode(F.when(near, F.array(home, visit)).otherwise(F.array(home))).alias("at")).select("project_id", "k", "h", "t", "at.slot", "at.kind")


def _route(trunk: Trunk):
    def run(batches):
        for b in batches:
            row, leaf, guest = trunk.route(b["h"].to_numpy().view(np.uint64), b["kind"].to_numpy() == 1)
            for lo in range(0, len(row), 50_000):
                r = b.take(pa.array(row[lo : lo + 50_000]))
                yield pa.RecordBatch.from_arrays(
                    [r["project_id"], r["slot"], pa.array(leaf[lo : lo + 50_000], pa.int32()), pa.array(guest[lo : lo + 50_000].astype(np.int32)), r["k"], r["h"], r["t"]],
                    names=["project_id", "slot", "leaf", "kind", "k", "h", "t"])

    return run


def _blocks(rows: DataFrame, limit: int) -> DataFrame:
    """Split what the tree couldn't part, such as very many copies of one fingerprint, into blocks by id.

    Shard (i, i) pairs the rows of block i, shard (i, j) those of block i with those of block j; each pair of home
    rows meets in one shard, and each visiting row meets every block once.
    """
    keys = ["project_id", "slot", "leaf"]
    counts = rows.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(limit)).cast("int").alias("b"))
    counts = counts.select(*[F.col(c).alias(f"c_{c}") for c in keys], "b")
    rows = rows.join(counts, [F.col(c) == F.col(f"c_{c}") for c in keys]).drop(*[f"c_{c}" for c in keys])
    own = F.pmod(F.xxhash64("k"), F.col("b")).cast("int")
    span = F.sequence(F.lit(0), F.col("b") - 1)
    shard = lambda i, j, kind: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), kind.cast("int").alias("kind"))
    # 0: at home, pairs with its like; 2: at home, pairs with visiting rows only; 1: visits
    home = F.concat(
        F.transform(span, lambda j: shard(F.col("own"), j, F.when(j == F.col("own"), 0).otherwise(2))),
        F.transform(F.filter(span, lambda i: i < F.col("own")), lambda i: shard(i, F.col("own"), F.lit(1))),
    )
    visit = F.transform(span, lambda i: shard(i, F.col("own"), F.lit(1)))
    put = rows.withColumn("own", own).withColumn("at", F.explode(F.when(F.col("kind") == 1, visit).otherwise(home)))
    return put.select(*keys, "at.i", "at.j", "at.kind", "k", "h", "t")


def _join_shards(radius: int, window: int):
    def pairs_of(rows: pa.Table):
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for c in _KEYS:
            x = rows[c].combine_chunks()
            new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        k, h, t = (rows[c].combine_chunks() for c in ("k", "h", "t"))
        again = ~new
        for x in (k, h, t):
            again[1:] &= pc.equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        shard = np.cumsum(new) - 1
        keep = np.flatnonzero(~again)
        kind = rows["kind"].to_numpy()
        own = np.ones(int(shard[-1]) + 1, bool)
        own[shard[kind == 2]] = False
        for i, j in near_pairs(shard[keep], kind[keep] == 1, rows["h"].to_numpy()[keep].view(np.uint64), rows["t"].to_numpy()[keep], radius, window, own):
            for lo in range(0, len(i), 50_000):
                yield pa.RecordBatch.from_arrays([k.take(pa.array(keep[i[lo : lo + 50_000]])), k.take(pa.array(keep[j[lo : lo + 50_000]]))], names=["a", "b"])

    def run(batches):
        held: list = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 50_000:
                continue
            rows = pa.Table.from_batches(held)
            changed = np.zeros(len(rows) - 1, bool)
            for c in _KEYS:
                x = rows[c].combine_chunks()
                changed |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
            if not changed.any():
                continue
            cut = int(np.flatnonzero(changed)[-1]) + 1
            yield from pairs_of(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
        if held and sum(x.num_rows for x in held):
            yield from pairs_of(pa.Table.from_batches(held))

    return run


def near_pairs_of_points(points: DataFrame, radius: int = RADIUS, window: int = WINDOW_MICROS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(a, b): the k of each pair of rows of one project within ``radius`` bits and ``window`` microseconds (at most
    WINDOW_MICROS), in no order; once, if no k has several rows that differ. points: (project_id, k, h, t), a written table without nulls.

    Rows are sharded by project and time slot, rows near the slot before visit that one too; in each shard a
    vantage-point tree finds the pairs. A slot of more than ``shard_rows`` rows is first parted by a routing tree,
    fitted on at most TRUNK_SAMPLE of the overfull slots' fingerprints (it decides only where rows meet, never
    whether), and what that can't part, such as copies of one fingerprint, by blocks of ids. So no task holds more than
    two blocks of a shard, and no pair is lost. Within a task, large nodes that can't be parted are searched by pigeonholes, not pair by pair.
    """
    ship(points.sparkSession)
    stash = Stash(points.sparkSession, "near-pairs")
    kind = points.schema["k"].dataType.simpleString()
    rows = _slots(points)
    hot = rows.groupBy("project_id", "slot").count().where(F.col("count") > shard_rows).select(F.col("project_id").alias("p"), F.col("slot").alias("s"))
    hot = stash.put(hot)
    plain = rows.withColumns({"leaf": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    if not hot.isEmpty():
        same = [F.col("project_id") == F.col("p"), F.col("slot") == F.col("s")]
        full = rows.join(hot, same, "left_semi")
        sample = full.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(TRUNK_SAMPLE).collect()
        trunk = Trunk(np.array([r.h for r in sample], np.int64).view(np.uint64), TRUNK_DEPTH, radius)
        routed = stash.put(full.mapInArrow(_route(trunk), f"project_id string, slot bigint, leaf int, kind int, k {kind}, h bigint, t bigint"))
        split = _blocks(routed, shard_rows)
        plain = plain.join(hot, same, "left_anti").unionByName(split)
    shards = plain.select(*_KEYS, "kind", "k", "h", "t").repartition(*_KEYS).sortWithinPartitions(*_KEYS, "k", "h", "t")
    found = shards.mapInArrow(_join_shards(radius, window), f"a {kind}, b {kind}")
    return found.where("a <> b")


def near_duplicates(photos: DataFrame, settings: DataFrame, **how) -> DataFrame:
    """(photo_a, photo_b), the smaller id first: each pair of near-duplicate photos, as near_pairs_of_points finds them.

    Null or malformed ids, projects, hashes and texts without instant have no pairs. Repeated rows count once (should rows of
    one id differ, each counts with its own values, but an id never pairs with itself). Empty tables give no pair; other columns
    don't matter.
    """
    points = Stash(photos.sparkSession, "fingerprints").put(fingerprints(photos, settings)).where("t is not null")
    pairs = near_pairs_of_points(points, **how).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()  # of rows that differ, several may link
    pairs = pairs.select(unpack_id(F.col("a")).alias("a"), unpack_id(F.col("b")).alias("b"))
    return pairs.select(F.least("a", "b").alias("photo_a"), F.greatest("a", "b").alias("photo_b"))
