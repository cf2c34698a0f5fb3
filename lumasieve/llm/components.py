"""Groups of directly or indirectly linked records by low-diameter decomposition.

Each vertex draws an exponential head start from a hash of its number. Clusters grow hop by hop from the vertices
with the largest head starts, a vertex joining the cluster that reaches it first; a level stops after HOPS hops.
Clusters become the vertices of the next level, links between clusters its edges, until no edge is left. Growth
without that stop would cut a link with a chance of about 1 - exp(-BETA); the stop, which bounds the joins of a level,
cuts more of those in wide clusters, which the next levels join. Each level's assignment and edges are written to the
shared folder; assignments are composed backwards, from the smallest level to the largest. Nothing but an emptiness
flag reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import pack_id, unpack_id
from ..runtime import Stash
from .near_pairs import fingerprints, near_pairs_of_points

BETA, HOPS = 0.2, 2


def _start(v: Column, level: int) -> Column:
    """Start time of a vertex: minus its exponential head start."""
    unit = (F.pmod(F.xxhash64(v, F.lit(level)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    return F.log(unit) / BETA


def _arrive(offers: DataFrame) -> DataFrame:
    """The earliest offer of each vertex."""
    return offers.groupBy("v").agg(F.min("at").alias("at"), F.min_by("c", "at").alias("c"))


def _grow(edges: DataFrame, level: int) -> DataFrame:
    """(v, c): the cluster of each vertex that has an edge. edges: (u, v), each link once."""
    offer = lambda v, c, hop: F.struct(F.col(v).alias("v"), F.col(c).alias("c"), (_start(F.col(c), level) + hop).alias("at"))
    first = edges.select(F.explode(F.array(offer("v", "u", 1), offer("u", "v", 1), offer("u", "u", 0), offer("v", "v", 0))).alias("o"))
    reached = _arrive(first.select("o.*"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    for _ in range(HOPS - 1):
        sent = both.join(reached.withColumnRenamed("v", "u"), "u").select("v", "c", (F.col("at") + 1).alias("at"))
        reached = _arrive(sent.unionByName(reached.select("v", "c", "at")))
    return reached.select("v", "c")


def components(edges: DataFrame, stash: Stash) -> DataFrame:
    """(v, c): every vertex of an edge with a vertex that stands for its component. edges: (u, v) of whole numbers.

    Nulls and loops link nothing; repeated and reversed edges count once. No edge gives no row.
    """
    edges = stash.put(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    levels = []
    while not edges.isEmpty():
        grown = stash.put(_grow(edges, len(levels)))
        levels.append(grown)
        cluster = lambda end: grown.select(F.col("v").alias(end), F.col("c").alias(f"c{end}"))  # noqa: B023, E731
        across = edges.join(cluster("u"), "u").join(cluster("v"), "v").where("cu <> cv")
        rest = stash.put(across.select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct())
        stash.drop(edges)
        edges = rest
    if not levels:
        return edges.select("v", F.col("u").alias("c"))
    whole = levels.pop()
    while levels:
        above = whole.select(F.col("v").alias("c"), F.col("c").alias("top"))
        whole = levels.pop().join(above, "c", "left").select("v", F.coalesce("top", "c").alias("c"))
    return whole


def _named(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(component_id, id): components of at least two named vertices, each under its smallest name."""
    rows = labels.join(names, labels.v == names.n).select("c", unpack_id(F.col("k")).alias("id"))
    least = rows.groupBy("c").agg(F.min("id").alias("component_id"), F.count("*").alias("size")).where("size > 1").drop("size")
    return rows.join(least, "c").select("component_id", "id")


def consolidate(links: DataFrame, a: str, b: str) -> DataFrame:
    """(component_id, id) of pairwise matches between text ids: each id with the smallest id it is linked with.

    Links with a null end or of an id with itself link nothing; repeated and reversed links count once; no link gives no
    row. Other columns don't matter.
    """
    stash = Stash(links.sparkSession, "components")
    ends = stash.put(links.where(F.col(a) != F.col(b)).select(pack_id(F.col(a)).alias("a"), pack_id(F.col(b)).alias("b")))
    names = stash.put(ends.select(F.explode(F.array("a", "b")).alias("k")).distinct().withColumn("n", F.monotonically_increasing_id()))
    number = lambda end, to: names.select(F.col("k").alias(end), F.col("n").alias(to))
    edges = ends.join(number("a", "u"), "a").join(number("b", "v"), "b").select("u", "v")
    return _named(components(edges, stash), names)


def photo_components(photos: DataFrame, settings: DataFrame, groups: DataFrame, members: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(component_id, photo_id): photos linked as near-duplicates or by a group of one of ``methods``.

    Photos get numbers first, so that all links are pairs of numbers; a group links each member with its first one.
    Members without photo, rows without id and groups without method link nothing. Repeated rows count once; should
    rows of one photo's id differ, one of them counts.
    """
    stash = Stash(photos.sparkSession, "photo-components")
    hashed = F.col("phash").rlike("^[0-9a-fA-F]{16}\\z")
    known = fingerprints(photos, settings, F.when(hashed, F.col("phash"))).dropDuplicates(["k"])
    known = stash.put(known.withColumn("n", F.monotonically_increasing_id()))
    pairs = near_pairs_of_points(known.where("h is not null and t is not null and project_id is not null").select("project_id", F.col("n").alias("k"), "h", "t"))
    kept = groups.where(F.col("method").isin(*methods) & F.col("id").isNotNull()).select(pack_id(F.col("id")).alias("g"))
    joined = members.select(pack_id(F.col("group_id")).alias("g"), pack_id(F.col("photo_id")).alias("k")).join(known.select("k", "n"), "k").select("g", "n")
    inside = stash.put(joined.join(kept, "g", "left_semi"))
    first = inside.groupBy("g").agg(F.min("n").alias("first"))
    shared = inside.join(first, "g").where("n <> first").select(F.col("first").alias("u"), F.col("n").alias("v"))
    edges = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(shared)
    return _named(components(edges, stash), known).withColumnRenamed("id", "photo_id")
