"""The command interface: projects, scanning, analysis, grouping, browsing, status and export on one store."""

from __future__ import annotations

import datetime as dt
import os
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import AnalyzerError, FileError, Invalid, NotFound
from .operators import browse, export, records, similarity
from .operators.analysis import analyse
from .operators.ordinal import ordinal
from .operators.transcode import MOST, transcode_file
from .runtime import Stash, scratch
from .schema import STATUSES
from .sources.media_files import media_files
from .store import Store, next_seq

Progress = Callable[[str, int, int | None, str], None]


def now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


@dataclass
class Scan:
    photos: DataFrame
    found: int
    skipped: int


@dataclass
class Analysis:
    analyzed: int = 0
    failed: int = 0
    cancelled: bool = False


@dataclass
class Grouping:
    groups: int = 0
    grouped_photos: int = 0


@dataclass
class Export:
    exported: int = 0
    renamed: int = 0
    skipped: int = 0
    failed: list[tuple[str, str]] = field(default_factory=list)


class Workspace:
    def __init__(self, spark: SparkSession, root: str, progress: Progress | None = None, batch: int = 100_000):
        """batch: photos of one step of analyze_pending; cancelling takes effect between steps."""
        self.spark, self.root, self.batch = spark, root, batch
        self.store = Store(spark, f"{root}/store")
        self.progress = progress or (lambda phase, done, total, status: None)
        self.current: str | None = None
        self._analysing, self._grouping, self._writing = threading.Lock(), threading.Lock(), threading.Lock()
        self._cancel = threading.Event()

    def _open(self) -> str:
        if self.current is None:
            raise Invalid("no project open")
        return self.current

    def echo(self, text: str) -> str:
        return text

    # --- projects

    def create_project(self, name: str) -> str:
        name = name.strip()
        if not name:
            raise Invalid("a project needs a name")
        project = str(uuid.uuid4())
        with self._writing:
            self.store.add("projects", (project, name, now()))
        return project

    def list_projects(self) -> DataFrame:
        return records.project_list(self.store.projects(), self.store.photos().select("id", "project_id"))

    def _known(self, project: str) -> None:
        if self.store.projects().where(F.col("id") == project).isEmpty():
            raise NotFound(f"project {project}")

    def open_project(self, project: str) -> None:
        self._known(project)
        with self._writing:
            self.store.add("openings", (project, next_seq(), now()))
        self.current = project

    def close_project(self) -> None:
        self.current = None

    def delete_project(self, project: str) -> None:
        self._known(project)
        with self._writing:
            self.store.delete_project(project)
        if self.current == project:
            self.current = None

    # --- photos

    def scan_folder(self, folder: str) -> Scan:
        """Take in the supported files below a folder. Files known already keep their state; entries that can't be read are counted."""
        project = self._open()
        if not os.path.isdir(folder):
            raise NotFound(f"folder {folder}")
        self.progress("import", 0, None, "running")
        try:
            # The folder is walked once; counts, inserts and the photos that come back go by that listing.
            files = Stash(self.spark, "scan").put(media_files(self.spark, folder))
            found = records.supported(files.where("error is null")).select(F.lit(project).alias("project_id"), "path").distinct()
            total, skipped = found.count(), files.where("error is not null").count()
            self.progress("import", 0, total, "running")
            with self._writing:
                stored = records.insert_if_absent(found, self.store.known(project), now())
                self.store.append("photos", stored.where("is_new"))
            photos = self.store.photos(project).join(found.select("path"), "path", "left_semi")
        except BaseException:
            self.progress("import", 0, None, "error")
            raise
        self.progress("import", total, total, "done")
        return Scan(photos, total, skipped)

    def set_status(self, photo: str, status: str) -> None:
        """Of this photo alone, whatever project is open; the last of several settings counts."""
        if status not in STATUSES:
            raise Invalid(f"status {status}")
        project = self.store.project_of(photo)
        if project is None:
            raise NotFound(f"photo {photo}")
        with self._writing:
            self.store.add("statuses", (photo, next_seq(), status, project))

    # --- analysis

    def analyze_pending(self, **thresholds) -> Analysis:
        """Analyse the open project's pending photos, step by step. A second call while one runs does nothing. A file that can't be analysed is
        failed; an error of the job itself leaves its step's photos pending and is raised."""
        if not self._analysing.acquire(blocking=False):
            return Analysis()
        try:
            project = self._open()
            self._cancel.clear()
            with scratch(self.spark):
                return self._analyse_all(project, thresholds)
        finally:
            self._analysing.release()

    def _analyse_all(self, project: str, thresholds: dict) -> Analysis:
        """The pending photos are listed and cut into steps once. A step's outcomes are made aside, and only added to the log under the lock."""
        stash, result, seen = Stash(self.spark, "analysis"), Analysis(), 0
        pending = self.store.photos(project).where("analysis_state = 'pending'").select("id", "path")
        steps = ordinal(pending, [], [F.asc("id")], "pos").select("id", "path", F.expr(f"(pos - 1) div {self.batch}").alias("step"))
        steps = stash.put(steps.repartition("step"))
        total = steps.count()
        for step in range(-(-total // self.batch)):
            if self._cancel.is_set():
                break
            try:
                spread = steps.where(F.col("step") == step).select("id", "path").repartition(self.spark.sparkContext.defaultParallelism)
                made = stash.put(analyse(spread, **thresholds).withColumns({"seq": F.lit(next_seq()), "project_id": F.lit(project)}))
                counts = made.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
                with self._writing:
                    self.store.append("outcomes", made)
            except Exception as e:
                self.progress("analyze", seen, total, "error")
                raise AnalyzerError(str(e)) from e
            stash.drop(made)
            result.analyzed, result.failed = result.analyzed + counts[0], result.failed + counts[1]
            seen += counts[0] + counts[1]
            self.progress("analyze", seen, total, "running")
        result.cancelled = self._cancel.is_set()
        self.progress("analyze", seen, total, "cancelled" if result.cancelled else "done")
        return result

    def compact(self) -> None:
        """Merge the logs of the open project, which many single settings and steps leave in small files."""
        with self._writing:
            self.store.compact(self._open())

    def cancel_analysis(self) -> None:
        self._cancel.set()

    # --- groups

    def group_photos(self) -> Grouping:
        """Replace the open project's groups of similar photos; the same photos give the same groups. A second call while one runs does nothing."""
        if not self._grouping.acquire(blocking=False):
            return Grouping()
        try:
            project = self._open()
            self.progress("group", 0, None, "running")
            with scratch(self.spark):
                version = self.store.write_groups(project, similarity.METHOD, *similarity.regrouped(self.store.photos(project)))
            with self._writing:
                self.store.use_groups(project, similarity.METHOD, version)
            groups, members = self.store.groups(project, similarity.METHOD)
            self.progress("group", 1, 1, "done")
            return Grouping(groups.count(), members.count())
        except BaseException:
            self.progress("group", 0, None, "error")
            raise
        finally:
            self._grouping.release()

    def list_groups(self) -> tuple[DataFrame, DataFrame]:
        """Grouped and ungrouped photos of the open project in display order, see operators.browse."""
        project = self._open()
        groups, members = self.store.groups(project, similarity.METHOD)
        photos = self.store.photos(project)
        return browse.browse_grouped(members, photos, groups), browse.browse_ungrouped(members, photos, groups)

    # --- files

    def export_keep(self, folder: str) -> Export:
        """Copy the kept photos of the open project to a folder, renaming where names clash; one file's failure stops no other."""
        project = self._open()
        if not os.path.isdir(folder):
            raise NotFound(f"folder {folder}")
        keeps = self.store.photos(project).where("status = 'keep'").select(F.lit(folder).alias("dest"), "id", "path")
        there = self.spark.createDataFrame([(folder, n) for n in os.listdir(folder)], "dest string, name string")
        target = f"{self.root}/exports/{next_seq()}"
        with scratch(self.spark):
            export.copy_planned(export.export_plan(keeps, there, on_disk=True)).write.parquet(target)
        done = self.spark.read.parquet(target)
        total = export.export_summary(done).first()
        failed = [(r.path, r.error) for r in done.where("outcome = 'failed'").orderBy("path").select("path", "error").collect()]
        return Export(total.exported, total.renamed, total.skipped, failed) if total else Export()

    def transcode_for_display(self, photo: str, most: int = MOST, ending: str = "jpg") -> str:
        """Path of a photo's display copy, made if there is none of its present state."""
        import hashlib

        row = self.store.known().where(F.col("id") == photo).select("path").first()
        if row is None or self.store.project_of(photo) is None:
            raise NotFound(f"photo {photo}")
        try:
            key = hashlib.sha256(f"{row.path}|{os.stat(row.path).st_mtime_ns}".encode()).hexdigest()
            dest = f"{self.root}/display/{key}.{ending}"
            if not os.path.exists(dest):
                transcode_file(row.path, dest, most)
            return dest
        except OSError as e:
            raise FileError(f"{type(e).__name__}: {e}") from e
        except ValueError as e:
            raise AnalyzerError(f"{type(e).__name__}: {e}") from e
