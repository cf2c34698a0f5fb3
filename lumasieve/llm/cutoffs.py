"""Score cutoffs per source that keep a target fraction of its records.

Scores are coded as whole numbers of CODE_BITS bits in an order-preserving way; DyadicCountTree keeps, per source,
the number of records in dyadic intervals of that code: layer L has the 2 ** (LAYER_BITS * L) intervals of equal length.
A batch adds its counts as rows of a written table, so the tree persists and grows without reading earlier batches. A
descent goes from the top layer to one code per source and looks at no more than 2 ** LAYER_BITS intervals of a
source in each layer; only the records of that code are then told apart by their exact score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.ids import pack_id, unpack_id
from ..runtime import Stash

CODE_BITS, LAYER_BITS = 32, 8
LAYERS = CODE_BITS // LAYER_BITS
_TOP = (1 << CODE_BITS) - 1


def score_code(score: Column) -> Column:
    """Order-preserving code of a score of at least 0: the logarithm of 1 + score in steps of 2 ** -22.

    Different scores may share a code, never change order. Infinity has the highest code.
    """
    return F.when(score == float("inf"), F.lit(_TOP)).otherwise(F.floor(F.log1p(score) * float(1 << 22)))


def usable_score(col: Column) -> Column:
    """The score if it is a number of at least 0, else null."""
    return F.when(~F.isnan(col) & (col >= 0), col)


class DyadicCountTree:
    """Counts of records by source and dyadic interval of their score code, as a table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add_batch(self, scored: DataFrame, batch: str) -> None:
        """Add the counts of ``scored`` (source, code), one row per record. Adding a batch of the same name again replaces it."""
        leaves = scored.groupBy("source", "code").agg(F.count("*").alias("n"))
        node = lambda layer: F.struct(F.lit(layer).alias("layer"), F.shiftright("code", CODE_BITS - LAYER_BITS * layer).alias("node"))
        nodes = leaves.select("source", "n", F.explode(F.array(*map(node, range(1, LAYERS + 1)))).alias("at"))
        counts = nodes.groupBy("source", "at.layer", "at.node").agg(F.sum("n").alias("n"))
        counts.write.mode("overwrite").option("compression", "zstd").partitionBy("layer").parquet(f"{self.path}/batch={batch}")

    def layer(self, layer: int) -> DataFrame:
        rows = self.spark.read.schema("source string, node bigint, n bigint, layer int, batch string").parquet(self.path)
        return rows.where(F.col("layer") == layer).groupBy("source", "node").agg(F.sum("n").alias("n"))

    def descend(self, targets: DataFrame) -> DataFrame:
        """(source, code, rank, above, total): the code of the record of each source's target rank, the rank among the records of
        that code, and the number of records of higher codes. targets: (source, permille), one row per source."""
        totals = self.layer(1).groupBy("source").agg(F.sum("n").alias("total"))
        rank = F.greatest(F.lit(1).cast("bigint"), F.expr("(total * permille + 999) div 1000"))
        path = totals.join(targets, "source").select("source", "total", rank.alias("rank"), F.lit(0).cast("bigint").alias("above"), F.lit(0).cast("bigint").alias("parent"))
        down = Window.partitionBy("source").orderBy(F.desc("node"))
        for layer in range(1, LAYERS + 1):
            nodes = self.layer(layer).withColumn("parent", F.shiftright("node", LAYER_BITS))
            run = path.join(nodes, ["source", "parent"]).withColumn("reach", F.sum("n").over(down))
            hit = run.where((F.col("reach") >= F.col("rank")) & (F.col("reach") - F.col("n") < F.col("rank")))
            passed = F.col("reach") - F.col("n")
            path = hit.select("source", "total", (F.col("rank") - passed).alias("rank"), (F.col("above") + passed).alias("above"), F.col("node").alias("parent"))
        return path.withColumnRenamed("parent", "code")


def refine(scored: DataFrame, leaves: DataFrame) -> DataFrame:
    """(source, cutoff, kept, total): the exact score at each source's rank within its leaf. Ties are counted before they meet the leaf."""
    ties = scored.groupBy("source", "code", "score").agg(F.count("*").alias("n"))
    within = ties.join(leaves, ["source", "code"])
    down = Window.partitionBy("source").orderBy(F.desc("score"))
    run = within.withColumn("reach", F.sum("n").over(down))
    hit = run.where((F.col("reach") >= F.col("rank")) & (F.col("reach") - F.col("n") < F.col("rank")))
    return hit.select("source", F.col("score").alias("cutoff"), (F.col("above") + F.col("reach")).alias("kept"), "total")


def _scored(photos: DataFrame, stash: Stash) -> DataFrame:
    score = usable_score(F.col("blur_score"))
    counted = photos.where((F.col("analysis_state") == "done") & score.isNotNull() & F.col("id").isNotNull() & F.col("project_id").isNotNull())
    rows = counted.select(F.col("project_id").alias("source"), pack_id(F.col("id")).alias("k"), F.col("blur_score").alias("score")).distinct()
    return stash.put(rows.withColumn("code", score_code(F.col("score"))))


def project_cutoffs(photos: DataFrame, settings: DataFrame, stash: Stash | None = None, scored: DataFrame | None = None) -> DataFrame:
    """(source, cutoff, kept, total) per project: the highest score that at least keep_permille of its counted photos reach.

    Photos in state done with a usable score, an id and a project count; rows repeated in full count once. A share of 0
    keeps the highest score's photos, one above 1000 or null has no cutoff, and neither has a project without counted photos or without
    settings. Of several settings of one project the smallest counts. Ties at the cutoff are all kept. Empty tables give no row.
    """
    stash = stash or Stash(photos.sparkSession, "cutoffs")
    scored = _scored(photos, stash) if scored is None else scored
    tree = DyadicCountTree(photos.sparkSession, f"{stash.root}/tree")
    tree.add_batch(scored, "0")
    return refine(scored, tree.descend(_targets(settings)))


def cutoffs_after_batches(batches: list[DataFrame], settings: DataFrame, path: str) -> DataFrame:
    """(source, cutoff, kept, total), as project_cutoffs gives them for all photos of ``batches`` together, from a tree that persists under ``path``.

    Each batch's nodes are counted from that batch alone and added to the tree; the descent reads counts only. Refining a target leaf takes
    the scores of all batches, of which only those of the leaf's code are looked at. A photo belongs to one batch.
    """
    spark = settings.sparkSession
    stash, tree = Stash(spark, "cutoffs"), DyadicCountTree(spark, path)
    scored = [_scored(b, stash) for b in batches]
    for i, rows in enumerate(scored):
        tree.add_batch(rows, str(i))
    every = scored[0]
    for more in scored[1:]:
        every = every.unionByName(more)
    return refine(every, tree.descend(_targets(settings)))


def _targets(settings: DataFrame) -> DataFrame:
    return settings.where("project_id is not null and keep_permille is not null").groupBy(F.col("project_id").alias("source")).agg(F.min("keep_permille").alias("permille"))


def kept_photos(photos: DataFrame, settings: DataFrame) -> DataFrame:
    """(project_id, photo_id): the counted photos that reach their project's cutoff; see project_cutoffs."""
    stash = Stash(photos.sparkSession, "cutoffs")
    scored = _scored(photos, stash)
    cut = stash.put(project_cutoffs(photos, settings, stash, scored)).select("source", "cutoff")
    kept = scored.join(cut, "source").where(F.col("score") >= F.col("cutoff"))
    return kept.select(F.col("source").alias("project_id"), unpack_id(F.col("k")).alias("photo_id"))
