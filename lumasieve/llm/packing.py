"""Filling containers of fixed capacity with documents of varying length.

Lengths are whole numbers of at most the capacity, so the plan needs only the number of documents of each length: a
table bounded by the capacity, whatever the corpus. ``plan`` fills containers in bulk, many equal ones at a time.
Documents above a third of the capacity fit at most twice into a container and are matched greedily, the longest
first, each with the longest partner that fits; smaller ones go, from long to short, to the tightest gap left. A
document then finds its container from its length and its rank among the documents of that length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import Stash, ship

#: Documents of one length that one task ranks; of a length with more, each part of about so many is ranked on its own.
RANKED = 1_000_000


class _Sizes:
    """A set of whole numbers with successor search, as bits of one integer."""

    def __init__(self):
        self.bits = 0

    def add(self, x: int) -> None:
        self.bits |= 1 << x

    def remove(self, x: int) -> None:
        self.bits &= ~(1 << x)

    def at_least(self, x: int) -> int | None:
        rest = self.bits >> x
        return x + (rest & -rest).bit_length() - 1 if rest else None

    def at_most(self, x: int) -> int | None:
        low = self.bits & ((1 << x + 1) - 1) if x >= 0 else 0
        return low.bit_length() - 1 if low else None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Rows (size, first rank, first container, count), and the number of containers.

    The documents of ``size`` with ranks from the first one on, ``count`` of them, go one each to successive containers.
    """
    rows: list[tuple[int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n > 0}
    if any(s < 1 or s > capacity for s in left):
        raise ValueError("sizes must be from 1 to the capacity")
    rank = dict.fromkeys(left, 0)
    made = 0
    gaps, gap_sizes = {}, _Sizes()

    def put(size: int, container: int, n: int) -> None:
        rows.append((size, rank[size], container, n))
        rank[size] += n
        left[size] -= n

    def leave(gap: int, container: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((container, n))
            gap_sizes.add(gap)

    large = _Sizes()
    for s in left:
        if 3 * s > capacity:
            large.add(s)
    while (s := large.at_most(capacity)) is not None:
        partner = large.at_most(min(s, capacity - s))
        if partner == s and left[s] == 1:
            partner = large.at_most(s - 1)
        n = left[s] if partner is None else left[s] // 2 if partner == s else min(left[s], left[partner])
        put(s, made, n)
        if partner is not None:
            put(partner, made, n)
        leave(capacity - s - (partner or 0), made, n)
        made += n
        for x in {s, partner} - {None}:
            if not left[x]:
                large.remove(x)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = gap_sizes.at_least(s)
            if gap is None:  # a new container is a gap of the whole capacity
                gap, start, n = capacity, made, -(-left[s] // (capacity // s))
                made += n
            else:
                start, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    gap_sizes.remove(gap)
            each = gap // s
            full = min(n, left[s] // each)
            for _ in range(each if full else 0):
                put(s, start, full)
            leave(gap - each * s, start, full)
            rest, start, n = left[s] if full < n else 0, start + full, n - full
            if n and rest:  # fewer than fill one container
                for _ in range(rest):
                    put(s, start, 1)
                leave(gap - rest * s, start, 1)
                start, n = start + 1, n - 1
            leave(gap, start, n)
    return rows, made


def pack(sizes: DataFrame, packs: DataFrame, ranked: int = RANKED) -> DataFrame:
    """(pack_name, doc_id, piece, tokens, container): every document assigned to a container of each pack.

    sizes: (doc_id, tokens); packs: (pack_name, capacity_tokens). A document is cut only if it exceeds the capacity: its pieces
    but the last are whole containers of their own, named doc_id:piece; the last piece is packed like a document of its length. No
    container is overfull. Repeated rows of a document count once (of differing lengths the longest); rows without id, without
    length or of no tokens are left out, and so are packs without name or capacity; of one name the smallest capacity counts.
    Empty tables give no row.
    """
    spark = sizes.sparkSession
    ship(spark)
    stash = Stash(spark, "packing")
    named = packs.where("pack_name is not null and capacity_tokens >= 1").groupBy("pack_name").agg(F.min("capacity_tokens").cast("bigint").alias("capacity")).orderBy("pack_name")
    capacities = [(r.pack_name, r.capacity) for r in named.collect()]  # the list of packs, not of documents
    schema = "pack_name string, doc_id bigint, piece bigint, tokens bigint, container string"
    if not capacities:
        return spark.createDataFrame([], schema)
    docs = stash.put(sizes.where("doc_id is not null and tokens > 0").groupBy("doc_id").agg(F.max("tokens").alias("tokens")))
    kind = F.explode(F.array(*[F.struct(F.lit(i).alias("pack"), F.lit(c).alias("capacity")) for i, (_, c) in enumerate(capacities)]))
    name = F.element_at(F.array(*[F.lit(n) for n, _ in capacities]), F.col("pack") + 1)
    each = docs.select("doc_id", "tokens", kind.alias("p")).select("doc_id", "tokens", "p.*")
    each = each.withColumn("whole", F.expr("tokens div capacity")).withColumn("size", F.expr("tokens % capacity"))
    items = each.where("size > 0")
    # A row for each length, at most as many as the capacities; and for lengths of very many documents, one for each ``ranked`` of them.
    lengths = items.groupBy("pack", "size").agg(F.ceil(F.count("*") / F.lit(ranked)).cast("int").alias("parts"))
    hot = [(r.pack, r["size"], r.parts) for r in lengths.where("parts > 1").collect()]
    hot = F.broadcast(spark.createDataFrame(hot, "p int, s bigint, parts int"))
    items = items.join(hot, (F.col("pack") == F.col("p")) & (F.col("size") == F.col("s")), "left").drop("p", "s")
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int"))
    counted = items.groupBy("pack", "size", "salt").agg(F.count("*").alias("n")).collect()
    base, counts = {}, [{} for _ in capacities]
    for r in sorted(counted):
        base[r.pack, r["size"], r.salt] = counts[r.pack].get(r["size"], 0)
        counts[r.pack][r["size"]] = counts[r.pack].get(r["size"], 0) + r.n
    rows = [(p, *row) for p, (_, c) in enumerate(capacities) for row in plan(counts[p], c)[0]]
    rows.sort()
    by_size = {k: i for i, k in enumerate(dict.fromkeys((p, s) for p, s, *_ in rows))}
    found = spark.sparkContext.broadcast({
        "start": np.array([by_size[p, s] << 40 | first for p, s, first, _, _ in rows], np.int64), "container": np.array([c for *_, c, _ in rows], np.int64),
        "size": by_size, "base": base})
    place = Window.partitionBy("pack", "size", "salt").orderBy("doc_id")
    ranked = items.withColumn("nth", F.row_number().over(place) - 1)

    def assign(batches):
        lookup = found.value
        for b in batches:
            pack_, size, salt, nth = (b[c].to_pylist() for c in ("pack", "size", "salt", "nth"))
            key = np.array([(lookup["size"][p, s] << 40) + lookup["base"][p, s, t] + n for p, s, t, n in zip(pack_, size, salt, nth)], np.int64)
            row = np.searchsorted(lookup["start"], key, "right") - 1
            container = lookup["container"][row] + (key - lookup["start"][row])
            yield pa.RecordBatch.from_arrays([b["pack"], b["doc_id"], b["whole"], b["size"], pa.array(container)], names=["pack", "doc_id", "piece", "tokens", "at"])

    last = ranked.select("pack", "doc_id", "whole", "size", "salt", "nth").mapInArrow(assign, "pack int, doc_id bigint, piece bigint, tokens bigint, at bigint")
    cut = each.where("whole > 0").select("pack", "doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"), F.col("capacity").alias("tokens"))
    parts = last.select(name.alias("pack_name"), "doc_id", "piece", "tokens", F.col("at").cast("string").alias("container")).unionByName(
        cut.select(name.alias("pack_name"), "doc_id", "piece", "tokens", F.concat_ws(":", "doc_id", "piece").alias("container")))
    return parts


def fill_report(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, containers, used, unused, least): containers of each pack, tokens in them, room left, and the fewest that could do."""
    by = packed.groupBy("pack_name", "container").agg(F.sum("tokens").alias("used")).groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("used").alias("used"))
    caps = packs.groupBy("pack_name").agg(F.min("capacity_tokens").cast("bigint").alias("capacity"))
    full = by.join(caps, "pack_name")
    return full.select("pack_name", "containers", "used", (F.col("containers") * F.col("capacity") - F.col("used")).alias("unused"), F.expr("(used + capacity - 1) div capacity").alias("least"))
