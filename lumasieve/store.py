"""The stored tables: append-only logs in Parquet under one folder, read as latest-wins views.

Photos, statuses, results of analysis, openings and deletions of projects are logs; a change is a row more. Groups are written as whole versions per
project and method, and a small pointer file is swapped when a version is complete, so a reader sees the old groups or the new ones. The logs that
grow with the photos are partitioned by project, so a project's views read its own files alone; ``compact`` merges these.
"""

from __future__ import annotations

import itertools
import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import Invalid, StoreError
from .operators import records
from .operators.analysis import OUTCOMES
from .schema import GROUP_MEMBERS, PHOTOS, SCHEMA_VERSION, SIMILAR_GROUPS

_LOGS = {
    "projects": "id string, name string, created_at string",
    "openings": "id string, seq bigint, at string",
    "deletions": "id string, seq bigint",
    "photos": "id string, project_id string, path string, created_at string",
    "statuses": "id string, seq bigint, status string, project_id string",
    "outcomes": f"{OUTCOMES}, seq bigint, project_id string",
}
_BY_PROJECT = ("photos", "statuses", "outcomes")
LAYOUT = 2
_counter = itertools.count()


def next_seq() -> int:
    """A number larger than all before in this process, and than those of earlier times."""
    return time.time_ns() // 1000 * 1000 + next(_counter) % 1000


class Store:
    """Tables under ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.migrate()

    # --- schema version

    def _described(self) -> dict:
        try:
            with open(f"{self.root}/schema.json") as f:
                return json.load(f)
        except FileNotFoundError:
            return {"version": 0}

    def version(self) -> int:
        return self._described()["version"]

    def migrate(self) -> None:
        """Bring the folder to SCHEMA_VERSION; each step is recorded when it is complete, and none runs twice. A folder of another layout is an error."""
        if self.version() == SCHEMA_VERSION and self._described().get("layout") != LAYOUT:
            raise StoreError("the store has another layout")
        if self.version() > SCHEMA_VERSION:
            raise StoreError(f"the store has version {self.version()}, newer than {SCHEMA_VERSION}")
        for step in range(self.version() + 1, SCHEMA_VERSION + 1):
            if step == SCHEMA_VERSION:
                for name in _LOGS:
                    os.makedirs(f"{self.root}/{name}", exist_ok=True)
            os.makedirs(self.root, exist_ok=True)
            self._swap("schema.json", {"version": step, "layout": LAYOUT})

    def _swap(self, name: str, content: dict) -> None:
        path = f"{self.root}/{name}"
        with open(f"{path}.part", "w") as f:
            json.dump(content, f)
        os.replace(f"{path}.part", path)

    # --- logs

    def read(self, name: str, project: str | None = None) -> DataFrame:
        """A log, or of a log by project the part of one; the other projects' files aren't looked at."""
        rows = self.spark.read.schema(_LOGS[name]).parquet(f"{self.root}/{name}")
        return rows if project is None else rows.where(F.col("project_id") == project)

    def append(self, name: str, rows: DataFrame) -> None:
        out = rows.select(*[x.split()[0] for x in _LOGS[name].split(", ")]).write.mode("append")
        (out.partitionBy("project_id") if name in _BY_PROJECT else out).parquet(f"{self.root}/{name}")

    def add(self, name: str, *rows: tuple) -> None:
        self.append(name, self.spark.createDataFrame(list(rows), _LOGS[name]))

    # --- views

    def projects(self) -> DataFrame:
        opened = self.read("openings").groupBy("id").agg(F.max_by("at", "seq").alias("last_opened_at"))
        return self.read("projects").join(self.read("deletions"), "id", "left_anti").join(opened, "id", "left")

    def known(self, project: str | None = None) -> DataFrame:
        """(id, project_id, path, status, created_at) of the photos that were taken in, by the photos' log alone; their status is left open."""
        return self.read("photos", project).withColumn("status", F.lit("pending"))

    def project_of(self, photo: str) -> str | None:
        """The project of a photo, if that is still there."""
        gone = self.read("deletions").select(F.col("id").alias("project_id"))
        row = self.read("photos").where(F.col("id") == photo).join(gone, "project_id", "left_anti").first()
        return row and row.project_id

    def photos(self, project: str | None = None) -> DataFrame:
        """Photos with the last state of everything, of all projects or of one."""
        base = self.read("photos", project).join(self.read("deletions").select(F.col("id").alias("project_id")), "project_id", "left_anti")
        empty = {f.name: F.lit(None).cast(f.dataType) for f in PHOTOS.fields}
        wide = base.withColumns({c: v for c, v in empty.items() if c not in base.columns}).withColumns({"status": F.lit("pending"), "analysis_state": F.lit("pending")})
        log = self.read("outcomes", project).drop("project_id")
        values = [n for n in log.columns if n not in ("id", "seq")]
        # A failure leaves the values of the last success.
        good = records.latest(log.where("ok"), ["id"], ["seq"], values)
        last = records.latest(log, ["id"], ["seq"], ["ok", "error"])
        done = records.with_analysis(wide, good)
        failed = records.with_analysis(done, last.where("not ok").select("id", "ok", "error", *[F.lit(None).cast(PHOTOS[c].dataType).alias(c) for c in values if c not in ("ok", "error")]))
        return records.with_status(failed, self.read("statuses", project)).select(*PHOTOS.fieldNames())

    def compact(self, project: str) -> None:
        """Merge a project's logs: one row a photo of photos and statuses, its last success and last outcome of outcomes, in few files.

        The merged rows are added before the old files go, and say nothing new, so a view is right at any time; a reader that has listed the old files
        already must start again. Not to be run beside writers of the project.
        """
        for name in _BY_PROJECT:
            folder = f"{self.root}/{name}/project_id={project}"
            old = [f"{folder}/{n}" for n in os.listdir(folder)] if os.path.isdir(folder) else []
            rows = self.read(name, project)
            rest = [c for c in rows.columns if c != "id"]
            if name == "outcomes":
                ranked = rows.withColumn("ok_", F.col("ok"))
                merged = records.latest(ranked, ["id", "ok_"], ["seq"], rest).drop("ok_")
            elif name == "statuses":
                merged = records.latest(rows, ["id"], ["seq"], rest)
            else:
                merged = rows.groupBy("id").agg(F.min(F.struct("created_at", "path", "project_id")).alias("v")).select("id", "v.*")
            if len(old) > 1:
                self.append(name, merged)
                for path in old:
                    os.remove(path)

    # --- groups

    def _current(self, project: str, method: str) -> str | None:
        try:
            with open(f"{self.root}/groups/{project}.{method}.json") as f:
                return json.load(f)["version"]
        except FileNotFoundError:
            return None

    def write_groups(self, project: str, method: str, groups: DataFrame, members: DataFrame) -> str:
        """Write a version of a project's groups, which no reader sees before ``use_groups``."""
        version = f"{project}.{method}.{next_seq()}"
        groups.write.parquet(f"{self.root}/groups/{version}/groups")
        members.write.parquet(f"{self.root}/groups/{version}/members")
        return version

    def use_groups(self, project: str, method: str, version: str) -> None:
        self._swap(f"groups/{project}.{method}.json", {"version": version})

    def groups(self, project: str, method: str) -> tuple[DataFrame, DataFrame]:
        version = self._current(project, method)
        if version is None:
            return self.spark.createDataFrame([], SIMILAR_GROUPS), self.spark.createDataFrame([], GROUP_MEMBERS)
        return tuple(self.spark.read.schema(s).parquet(f"{self.root}/groups/{version}/{n}") for n, s in (("groups", SIMILAR_GROUPS), ("members", GROUP_MEMBERS)))

    def delete_project(self, project: str) -> None:
        """Groups, photos and everything else of a project go with it, for all views anti-join the deletions."""
        if "/" in project:
            raise Invalid("a project id holds no slash")
        self.add("deletions", (project, next_seq()))
        folder = f"{self.root}/groups"
        for name in os.listdir(folder) if os.path.isdir(folder) else []:
            if name.startswith(f"{project}.") and name.endswith(".json"):
                os.remove(f"{folder}/{name}")
