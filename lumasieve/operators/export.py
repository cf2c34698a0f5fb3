"""Export of kept photos: where each file goes, and the copying."""

from __future__ import annotations

import os
import shutil

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.photo import MAX_RENAMES, name_parts, renamed
from ..runtime import Stash, ship

_PLAN = "dest string, id string, path string, name string, target string, outcome string, error string"
#: Parts in which the files of one name are ranked first.
PARTS = 64


def _lies_in(path: pd.Series, folder: pd.Series) -> pd.Series:
    """Whether a file lies directly in a folder, links resolved; if that fails, by the names alone, for a file that exists."""

    def one(p: str | None, d: str | None) -> bool:
        if not p or not d:
            return False
        try:
            return os.path.dirname(os.path.realpath(p, strict=True)) == os.path.realpath(d, strict=True)
        except OSError:
            return os.path.isfile(p) and os.path.normpath(os.path.dirname(p)) == os.path.normpath(d)

    return pd.Series([one(p, d) for p, d in zip(path, folder)], dtype=bool)


def _slots_taken(names: DataFrame) -> DataFrame:
    """(dest, name, taken): by name the numbers n from 1 to 9999, in order, whose form 'stem (n).ext' is among ``names`` (dest, name) itself."""
    stem, ext = name_parts(F.col("name"))
    numbered = r"^(.+) \(([1-9]\d{0,3})\)\z"
    base, n = F.concat(F.regexp_extract(stem, numbered, 1), ext), F.regexp_extract(stem, numbered, 2).cast("int")
    forms = names.where(stem.rlike(numbered)).select("dest", "name", base.alias("base"), n.alias("n"))
    forms = forms.where(renamed(F.col("base"), F.col("n")) == F.col("name"))
    return forms.groupBy("dest", "base").agg(F.array_sort(F.collect_set("n")).alias("taken")).withColumnRenamed("base", "name")


def export_plan(keeps: DataFrame, existing: DataFrame, on_disk: bool = False) -> DataFrame:
    """(dest, id, path, name, target, outcome, error): the name each kept file gets in its destination.

    keeps: (dest, id, path); existing: (dest, name) of files that are there. A file takes its own name if that is free, else the first free of
    'stem (1).ext', 'stem (2).ext', ... up to 9999. First each name goes to the file of smallest id that bears it; then the others are numbered, by id.
    on_disk: look at the disk to tell which files lie in the destination. outcome: exported, renamed, skipped (it lies there already) or failed (no
    file name, or no name left). Nulls in dest or id are left out; a null path has no file name. Repeated rows count once.

    As own names go first, a number of a name is taken if a file that is there or is exported bears it, whatever the order, so every file's target
    follows from its rank among the files of its name. Ranks are taken in PARTS parts of a name first; of each part only as many files go on as
    there are names in all, so no task holds more than that many for each part.
    """
    ship(keeps.sparkSession)
    stash = Stash(keeps.sparkSession, "export")
    whole = keeps.select("dest", "id", "path").where("dest is not null and id is not null").distinct()
    named = whole.withColumn("name", F.nullif(F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/\\]*)\z", 1), F.lit("")))
    folder = F.regexp_extract("path", r"^(.*?)[/\\]+[^/\\]*\z", 1)
    here = F.pandas_udf(_lies_in, "boolean")("path", "dest") if on_disk else folder == F.col("dest")
    early = F.when(F.col("name").isNull(), "failed").when(here, "skipped")
    part = Window.partitionBy("dest", "name", F.pmod(F.xxhash64("id"), F.lit(PARTS))).orderBy("id", "path")
    rows = stash.put(named.withColumn("early", early).withColumn("nth", F.when(F.col("early").isNull(), F.row_number().over(part))))
    no_target = F.lit(None).cast("string").alias("target")
    settled = rows.where("early is not null").select("dest", "id", "path", "name", no_target, F.col("early").alias("outcome"), F.when(F.col("early") == "failed", "no file name").alias("error"))
    far = rows.where(F.col("nth") > MAX_RENAMES + 1).select("dest", "id", "path", "name", no_target, F.lit("failed").alias("outcome"), F.lit("no free name").alias("error"))
    near = rows.where(F.col("nth") <= MAX_RENAMES + 1).drop("early", "nth")

    there = existing.select("dest", "name").where("dest is not null and name is not null").distinct()
    bearers = near.select("dest", "name").distinct()
    taken = _slots_taken(bearers.unionByName(there).distinct())
    names = bearers.join(there.withColumn("there", F.lit(1)), ["dest", "name"], "left").join(taken, ["dest", "name"], "left")
    rank = F.row_number().over(Window.partitionBy("dest", "name").orderBy("id", "path")) - 1
    ranked = near.withColumn("nth", rank).join(names, ["dest", "name"])
    r = F.col("nth") + F.coalesce("there", F.lit(0))
    # The r-th free number: each taken one that is not after it moves it on by one.
    before = F.size(F.filter(F.coalesce("taken", F.array().cast("array<int>")), lambda x, i: x - i <= r))
    at = F.when(r == 0, 0).otherwise(r + before)
    free = at <= MAX_RENAMES
    placed = ranked.select(
        "dest", "id", "path", "name", F.when(free, renamed(F.col("name"), at)).alias("target"), F.when(~free, "failed").when(at == 0, "exported").otherwise("renamed").alias("outcome"),
        F.when(~free, "no free name").alias("error"))
    return settled.unionByName(placed).unionByName(far)


def export_summary(plan: DataFrame) -> DataFrame:
    """(dest, exported, renamed, skipped, failed): files copied (renamed ones among them), renamed, lying there already, and failed."""
    is_ = lambda *k: F.count_if(F.col("outcome").isin(*k))
    return plan.groupBy("dest").agg(is_("exported", "renamed").alias("exported"), is_("renamed").alias("renamed"), is_("skipped").alias("skipped"), is_("failed").alias("failed"))


def copy_planned(plan: DataFrame) -> DataFrame:
    """The plan after copying: each file to be exported is copied to its destination; one that can't be is failed, and leaves nothing behind.

    Sources are never changed. Copying is an effect: write the result once.
    """

    def copy(batches):
        for pdf in batches:
            outcome, error = pdf["outcome"].tolist(), pdf["error"].tolist()
            for i, r in enumerate(pdf.itertuples()):
                if r.outcome not in ("exported", "renamed"):
                    continue
                target = os.path.join(r.dest, r.target)
                part = f"{target}.{r.id[:16]}.part"
                try:
                    if not os.path.isfile(r.path):
                        raise OSError("source is no file")
                    shutil.copy2(r.path, part)
                    os.replace(part, target)
                except OSError as e:
                    outcome[i], error[i] = "failed", f"{type(e).__name__}: {e}"
                    if os.path.exists(part):
                        os.remove(part)
            yield pdf.astype(object).assign(outcome=pd.Series(outcome, pdf.index, object), error=pd.Series(error, pdf.index, object))

    ship(plan.sparkSession)
    return plan.mapInPandas(copy, _PLAN)
