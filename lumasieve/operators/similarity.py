"""Groups of similar photos of a project: near hashes, connected components, derived groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.ids import pack_id, unpack_id
from ..functions.photo import LANES, digest_lanes, group_params, parse_phash, set_digest
from ..functions.pigeonholes import near
from ..runtime import Stash, ship
from .ordinal import ordinal

# The method's name and the largest distance of similar hashes.
METHOD, THRESHOLD = "phash_burst", 8
#: Hashes of a project from which on it is parted into blocks, and into how many at most.
BLOCK, MOST_BLOCKS = 50_000, 32
_CELL = ["project_id", "i", "j"]


def hashes(photos: DataFrame) -> DataFrame:
    """(project_id, h, k): photos with a valid hash, whatever their state, once each, under their packed id."""
    rows = photos.select("project_id", parse_phash(F.col("phash")).alias("h"), "id").where("h is not null and project_id is not null and id is not null")
    return rows.select("project_id", "h", pack_id(F.col("id")).alias("k")).distinct()


def _near_cells(threshold: int, extra: bool, names: list[str]):
    def pairs_of(rows: pa.Table):
        changed = np.flatnonzero(_changes(rows)) + 1
        edges = np.concatenate([[0], changed, [len(rows)]])
        h, side, project = rows["h"].to_numpy(), rows["side"].to_numpy(), rows["project_id"].combine_chunks()
        n = rows["n"].to_numpy() if extra else None
        held, many = [], 0

        def flush():
            i, j = (np.concatenate(x) for x in zip(*held))
            a, b = np.where(h[i] < h[j], i, j), np.where(h[i] < h[j], j, i)
            for lo in range(0, len(a), 50_000):
                x, y = a[lo : lo + 50_000], b[lo : lo + 50_000]
                distance = np.bitwise_count((h[x] ^ h[y]).view(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([project.take(pa.array(x)), pa.array(h[x]), pa.array(h[y]), pa.array(distance)] + ([pa.array(n[x]), pa.array(n[y])] if extra else []), names=names)

        for lo, hi in zip(edges[:-1][np.diff(edges) > 1].tolist(), edges[1:][np.diff(edges) > 1].tolist()):
            own, cross = h[lo:hi].view(np.uint64), side[hi - 1] == 1
            mid = int(np.searchsorted(side[lo:hi], 1))
            for i, j in near(own[:mid], own[mid:], threshold) if cross else near(own, None, threshold):
                if len(i):
                    held.append((i + lo, j + lo + (mid if cross else 0)))
                    many += len(i)
                    if many >= 50_000:
                        yield from flush()
                        held, many = [], 0
        if held:
            yield from flush()

    def run(batches):
        # Rows come ordered by cell; those up to the last change of cell can go.
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            before = held[-1:]
            changed = np.flatnonzero(_changes(pa.Table.from_batches([*[x.slice(x.num_rows - 1) for x in before], b]))) + 1 - len(before)
            if not len(changed):
                held.append(b)
                continue
            cut = int(changed[-1])
            yield from pairs_of(pa.Table.from_batches([*held, b.slice(0, cut)]))
            held = [b.slice(cut)]
        if held:
            yield from pairs_of(pa.Table.from_batches(held))

    return run


def _changes(rows: pa.Table) -> np.ndarray:
    """For each row but the last, whether the next one is of another cell."""
    changed = np.zeros(max(0, len(rows) - 1), bool)
    for c in _CELL:
        x = rows[c].combine_chunks()
        changed |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
    return changed


def near_hashes(classes: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(project_id, a, b, distance), a < b: pairs of different hashes of a project within the threshold.

    classes: (project_id, h), each once, a written table; so copies of a hash don't multiply. A number n of each comes out again as n_a and n_b.
    A project of up to ``block`` hashes goes to one cell. Those of a larger one are parted into blocks, and each two blocks, and each with itself, meet in a
    cell of their own, so a hash is sent as often as there are blocks: at most MOST_BLOCKS times, beyond which blocks grow. In a cell, hashes meet by
    pigeonholes (``functions.pigeonholes``): of N evenly spread hashes some N * N / 290 pairs, in arrays of bounded size. Nothing is joined but the few large projects.
    """
    if threshold > 14:
        raise ValueError("pieces of less than four bits don't narrow anything down")
    ship(classes.sparkSession)
    extra = [c for c in classes.columns if c == "n"]
    rows = classes.where("project_id is not null and h is not null").select("project_id", "h", *extra)
    large = rows.groupBy("project_id").agg(F.count("*").alias("rows")).where(F.col("rows") > block)
    large = large.select("project_id", F.least(F.ceil(F.col("rows") / block), F.lit(MOST_BLOCKS)).cast("int").alias("blocks"))
    # At most one row in ``block`` of the table's: the one side that is always small enough to send.
    placed = rows.join(F.broadcast(large), "project_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j"), (F.col("own") > k).cast("int").alias("side")))
    cells = placed.withColumn("own", own).withColumn("at", F.explode(meets)).select("project_id", "at.i", "at.j", "at.side", "h", *extra)
    cells = cells.repartition(*_CELL).sortWithinPartitions(*_CELL, "side")
    ends = [f"{c}_{e}" for c in extra for e in "ab"]
    kind = classes.schema["project_id"].dataType.simpleString()
    return cells.mapInArrow(_near_cells(threshold, bool(extra), ["project_id", "a", "b", "distance", *ends]), f"project_id {kind}, a bigint, b bigint, distance int" + "".join(f", {e} bigint" for e in ends))


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): each end of an edge with the smallest end of its component.

    Alternates two contractions until nothing changes: each node links its larger neighbours to the smallest node around it, then its
    smaller ones. Each round is written to the shared folder; only a digest of it reaches the driver. Written numbers take far less room in files than in
    memory, so Spark isn't left to send a side of a join through the driver by the size of its files.
    """
    stash = Stash(edges.sparkSession, "connected")
    pair = lambda df: df.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()

    def star(now: DataFrame, larger: bool) -> DataFrame:
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v"))
        if larger:
            both = both.unionByName(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        to_least = both.join(least.hint("merge"), "u")
        if larger:
            return pair(to_least.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y")))
        own = least.select(F.col("u").alias("x"), F.col("m").alias("y"))
        return pair(to_least.select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(own))

    def state(df: DataFrame):
        code = F.xxhash64("x", "y")
        return tuple(df.agg(F.count("*"), F.bit_xor(code), F.sum(F.pmod(code, F.lit(1 << 31)))).first())

    now = stash.put(pair(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))))
    before = state(now)
    while True:
        new = stash.put(star(star(now, True), False))
        after = state(new)
        stash.drop(now)
        now = new
        if after == before:
            break
        before = after
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())


def _placed(photos: DataFrame, threshold: int, *more) -> tuple[DataFrame, DataFrame]:
    """(rows, placed): the photos as of ``hashes``, and (project_id, h, copies, c) of each different hash in a component of at least two photos, under
    the component's number, with aggregates ``more`` over the photos of a hash.

    Components are sought among different hashes, which get numbers first.
    """
    stash = Stash(photos.sparkSession, "clusters")
    rows = stash.put(hashes(photos))
    classes = stash.put(rows.groupBy("project_id", "h").agg(F.count("*").alias("copies"), *more).withColumn("n", F.monotonically_increasing_id()))
    found = connected(near_hashes(classes.select("project_id", "h", "n"), threshold), "n_a", "n_b")
    placed = classes.join(found.hint("merge"), F.col("n") == F.col("node"), "left").where("root IS NOT NULL OR copies > 1")
    return rows, stash.put(placed.withColumn("c", F.coalesce("root", "n")).drop("n", "node", "root"))


def clusters(photos: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(project_id, root, id): photos in a component of at least two, by hash distance alone, under the component's smallest hash.

    Photos without valid hash are left out; the others join their component by hash.
    """
    rows, placed = _placed(photos, threshold)
    least = placed.groupBy("c").agg(F.min("h").alias("root"))
    known = placed.select("project_id", "h", "c").join(least.hint("merge"), "c")
    return rows.join(known.hint("merge"), ["project_id", "h"]).select("project_id", "root", unpack_id(F.col("k")).alias("id"))


def regrouped(photos: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of all projects: (id, project_id, method, params) and (group_id, photo_id).

    A group's id is a digest of the method and the set of its members, taken without gathering them, from the digests of its different hashes: the same
    members always make the same id, in any order.
    """
    rows, placed = _placed(photos, threshold, *digest_lanes(unpack_id(F.col("k"))))
    merged = placed.groupBy("project_id", "c").agg(F.sum("copies").alias("size"), *[F.bit_xor(lane).alias(lane) for lane in LANES])
    ids = Stash(photos.sparkSession, "regrouped").put(merged.select("project_id", "c", F.unhex(set_digest(METHOD, F.col("size"), [F.col(lane) for lane in LANES])).alias("g")))
    text = F.lower(F.hex("g"))
    groups = ids.select(text.alias("id"), "project_id", F.lit(METHOD).alias("method"), group_params(threshold).alias("params"))
    known = placed.select("project_id", "h", "c").join(ids.select("c", "g").hint("merge"), "c").select("project_id", "h", "g")
    return groups, rows.join(known.hint("merge"), ["project_id", "h"]).select(text.alias("group_id"), unpack_id(F.col("k")).alias("photo_id"))


def member_order(members: DataFrame) -> DataFrame:
    """(group_id, pos, photo_id): the members of each group numbered by id, byte by byte, each once; the sorted list in flat form, for groups of any size."""
    return ordinal(members.select("group_id", "photo_id").distinct(), ["group_id"], [F.asc("photo_id")], "pos").select("group_id", "pos", "photo_id")
