"""The registered queries of the core: name -> (spark, sf_dir) -> DataFrame, and their SQL twins."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import photo as P
from ..operators import browse, export, records, similarity
from ..operators.analysis import analyse
from ..operators.instants import photo_instants
from ..operators.transcode import transcode
from ..runtime import Stash, ship, table
from ..schema import degraded
from ..sources.exif import shot_at
from ..sources.json_lines import respond
from ..sources.media_files import media_files, scan_summary as media_scan_summary
from ..streaming.ingest import status_counts
from .instants_sql import INSTANTS

QUERIES = {}
ORACLE = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _tables(spark, d, *names):
    return [table(spark, d, n) for n in names]


# --- problem 2 -----------------------------------------------------------------------------------------------------


@query(f"WITH {INSTANTS} SELECT photo_id, field, utc_micros FROM instants")
def p2_found(spark, d):
    return photo_instants(*_tables(spark, d, "photos", "project_settings"))


# --- scans and inserts -----------------------------------------------------------------------------------------------


@query(r"SELECT id, path FROM photos WHERE regexp_matches(path, '(?i)[^/\\]\.(jpg|jpeg|png|heic|heif)$')")
def scan_supported(spark, d):
    return records.supported(table(spark, d, "photos")).select("id", "path")


NOW = "2026-01-01T00:00:00+00:00"


@query(f"""
WITH old AS (SELECT DISTINCT id, status, created_at FROM photos WHERE analysis_state <> 'pending'),
found AS (SELECT DISTINCT project_id, path, sha256(project_id || chr(10) || path) AS id FROM photos)
SELECT f.id, project_id, path, coalesce(status, 'pending') AS status, coalesce(created_at, '{NOW}') AS created_at, created_at IS NULL AS is_new
FROM found f LEFT JOIN old o ON f.id = o.id
""")
def insert_if_absent(spark, d):
    photos = table(spark, d, "photos")
    return records.insert_if_absent(photos, photos.where("analysis_state <> 'pending'"), NOW)


@query("SELECT id, sha256(project_id || chr(10) || path) AS derived FROM photos")
def photo_ids(spark, d):
    return table(spark, d, "photos").select("id", P.photo_id(F.col("project_id"), F.col("path")).alias("derived"))


@query("SELECT id, path FROM photos WHERE analysis_state = 'pending'")
def pending_queue(spark, d):
    return table(spark, d, "photos").where("analysis_state = 'pending'").select("id", "path")


@query("SELECT project_id, path FROM photos WHERE status = 'keep'")
def keep_paths(spark, d):
    return table(spark, d, "photos").where("status = 'keep'").select("project_id", "path")


@query("SELECT id, sha256(path || '|' || cast(length(path) * 1000003 AS VARCHAR)) AS cache_key FROM photos WHERE regexp_matches(path, '(?i)\\.(heic|heif)$')")
def transcode_keys(spark, d):
    rows = table(spark, d, "photos").where(P.is_heic(F.col("path")))
    return rows.select("id", P.cache_key(F.col("path"), F.length("path") * 1000003).alias("cache_key"))


# --- scalar functions ----------------------------------------------------------------------------------------------


@query(r"""
SELECT id, coalesce(nullif(regexp_extract(path, '([^/\\]*)$', 1), ''), path) AS name, regexp_matches(path, '(?i)\.(heic|heif)$') AS heic,
  concat_ws(',', CASE WHEN is_blurry THEN 'blur' END, CASE WHEN exposure_flag IN ('over', 'under') THEN exposure_flag END) AS badges
FROM photos
""")
def photo_labels(spark, d):
    return browse.photo_labels(table(spark, d, "photos"))


@query("""
SELECT id, CASE WHEN status IN ('pending', 'keep', 'reject') THEN status ELSE 'pending' END AS status,
  CASE WHEN exposure_flag IN ('normal', 'over', 'under') THEN exposure_flag END AS exposure_flag,
  CASE WHEN analysis_state IN ('pending', 'done', 'failed') THEN analysis_state ELSE 'pending' END AS analysis_state
FROM photos
""")
def enum_degradation(spark, d):
    return degraded(table(spark, d, "photos")).select("id", "status", "exposure_flag", "analysis_state")


@query("""
WITH v AS (SELECT id, phash, list_transform(string_split(lower(phash), ''), lambda c: instr('0123456789abcdef', c) - 1) AS x FROM photos WHERE regexp_full_match(phash, '[0-9a-fA-F]{16}'))
SELECT p.id, cast(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS h
FROM photos p LEFT JOIN (SELECT DISTINCT id, phash, list_reduce(list_transform(x, lambda e: e::HUGEINT), lambda a, e: a * 16 + e) AS u FROM v) v ON p.id = v.id AND p.phash = v.phash
""")
def phash_parse(spark, d):
    return table(spark, d, "photos").select("id", P.parse_phash(F.col("phash")).alias("h"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 > 0.8 OR l_discount * 6 >= 0.5 THEN 'over' WHEN l_quantity / 50 < 0.2 OR l_tax * 7 >= 0.5 THEN 'under' ELSE 'normal' END AS flag
FROM lineitem
""")
def exposure_flag(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", P.exposure_flag(F.col("l_quantity") / 50, F.col("l_discount") * 6, F.col("l_tax") * 7).alias("flag"))


@query("""
WITH s AS (SELECT p_partkey, p_size * 3 AS w, (p_partkey % 97 + 1)::INT AS h FROM part),
t AS (SELECT *, 30.0::DOUBLE / greatest(w, h) AS scale FROM s)
SELECT p_partkey,
  CASE WHEN greatest(w, h) <= 30 THEN w ELSE greatest(1, round_even(w * scale, 0))::INT END AS width,
  CASE WHEN greatest(w, h) <= 30 THEN h ELSE greatest(1, round_even(h * scale, 0))::INT END AS height
FROM t
""")
def fit_dims(spark, d):
    w, h = F.col("p_size") * 3, (F.col("p_partkey") % 97 + 1).cast("int")
    return table(spark, d, "part").select("p_partkey", P.fit_side(w, h, 30).alias("width"), P.fit_side(h, w, 30).alias("height"))


@query("""
SELECT id, CASE WHEN total > 0 THEN least(100, floor(done / total * 100 + 0.5))::INT END AS percent FROM (
  SELECT id, length(name)::DOUBLE AS done, (length(name) % 7 * 5)::DOUBLE AS total FROM projects)
""")
def progress_percent(spark, d):
    return table(spark, d, "projects").select("id", P.percent(F.length("name").cast("double"), (F.length("name") % 7 * 5).cast("double")).alias("percent"))


@query("""
SELECT id, coalesce(strftime(try_cast(last_opened_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M'), last_opened_at, 'never') AS opened FROM projects
""")
def shown_dates(spark, d):
    return table(spark, d, "projects").select("id", P.shown_date(F.col("last_opened_at"), "never").alias("opened"))


@query("""
SELECT id, method, try_cast(json_extract_string(params, '$.threshold') AS INT) AS threshold, try_cast(json_extract_string(params, '$.version') AS INT) AS version,
  '{"threshold":8,"version":1}' AS written
FROM similar_groups
""")
def group_params(spark, d):
    read = F.from_json("params", "threshold int, version int")
    return table(spark, d, "similar_groups").select("id", "method", read["threshold"].alias("threshold"), read["version"].alias("version"), P.group_params(8).alias("written"))


# --- similarity ------------------------------------------------------------------------------------------------------

_HASHED = """
v AS (SELECT DISTINCT project_id, id, lower(phash) AS hex, list_transform(string_split(lower(phash), ''), lambda c: (instr('0123456789abcdef', c) - 1)::HUGEINT) AS x
      FROM photos WHERE regexp_full_match(phash, '[0-9a-fA-F]{16}')),
u AS (SELECT project_id, id, list_reduce(x, lambda a, e: a * 16 + e) AS n FROM v),
hashed AS (SELECT project_id, id, cast(CASE WHEN n >= 9223372036854775808 THEN n - 18446744073709551616 ELSE n END AS BIGINT) AS h FROM u),
classes AS (SELECT project_id, h, count(*) AS n FROM hashed GROUP BY ALL)
"""


@query(f"""
WITH {_HASHED}
SELECT a.project_id, a.h AS a, b.h AS b, bit_count(xor(a.h, b.h))::INT AS distance, a.n AS photos_a, b.n AS photos_b
FROM classes a JOIN classes b ON a.project_id = b.project_id AND a.h < b.h AND bit_count(xor(a.h, b.h)) <= 8
""")
def near_hashes(spark, d):
    """Pairs between different hashes of a project, with the number of photos that carry each."""
    classes = Stash(spark, "classes").put(similarity.hashes(table(spark, d, "photos")).groupBy("project_id", "h").agg(F.count("*").alias("n")))
    pairs = similarity.near_hashes(classes)
    return pairs.select("project_id", "a", "b", "distance", F.col("n_a").alias("photos_a"), F.col("n_b").alias("photos_b"))


_CLUSTERS = f"""
{_HASHED},
edges AS (SELECT a.project_id, a.h AS a, b.h AS b FROM classes a JOIN classes b ON a.project_id = b.project_id AND a.h <> b.h AND bit_count(xor(a.h, b.h)) <= 8),
reach AS (SELECT project_id, h, h AS root FROM classes UNION SELECT e.project_id, e.b, r.root FROM reach r JOIN edges e ON r.project_id = e.project_id AND r.h = e.a),
roots AS (SELECT project_id, h, min(root) AS root FROM reach GROUP BY ALL),
placed AS (SELECT project_id, root, id FROM hashed JOIN roots USING (project_id, h)),
clusters AS (SELECT project_id, root, id FROM placed WHERE (project_id, root) IN (SELECT (project_id, root) FROM placed GROUP BY project_id, root HAVING count(*) > 1))
"""


@query(f"WITH RECURSIVE {_CLUSTERS} SELECT project_id, root, id FROM clusters")
def similar_clusters(spark, d):
    return similarity.clusters(table(spark, d, "photos"))


def _lane(i: int) -> str:
    return f"bit_xor(cast(('0x' || substr(sha256(id), {16 * i + 1}, 16)) AS UBIGINT))"


_SIGNED = "cast(CASE WHEN {0} >= 9223372036854775808 THEN {0}::HUGEINT - 18446744073709551616 ELSE {0} END AS VARCHAR)"
_GROUPS = f"""
{_CLUSTERS},
lanes AS (SELECT project_id, root, count(*) AS n, {", ".join(f"{_lane(i)} AS x{i}" for i in range(4))} FROM clusters GROUP BY ALL),
ids AS (SELECT project_id, root, sha256(concat_ws(chr(10), 'phash_burst', n, {", ".join(_SIGNED.format(f"x{i}") for i in range(4))})) AS group_id FROM lanes)
"""


@query(f"""WITH RECURSIVE {_GROUPS} SELECT group_id AS id, project_id, 'phash_burst' AS method, '{{"threshold":8,"version":1}}' AS params FROM ids""")
def similar_groups(spark, d):
    return similarity.regrouped(table(spark, d, "photos"))[0]


@query(f"WITH RECURSIVE {_GROUPS} SELECT group_id, id AS photo_id FROM clusters JOIN ids USING (project_id, root)")
def group_members(spark, d):
    return similarity.regrouped(table(spark, d, "photos"))[1]


@query("SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY photo_id) AS pos, photo_id FROM (SELECT DISTINCT group_id, photo_id FROM group_members)")
def member_order(spark, d):
    return similarity.member_order(table(spark, d, "group_members"))


@query("""
WITH sizes AS (SELECT group_id, count(*) AS n FROM (SELECT DISTINCT group_id, photo_id FROM group_members) GROUP BY group_id)
SELECT project_id, count(*) AS groups, sum(n)::BIGINT AS grouped_photos FROM similar_groups JOIN sizes ON id = group_id WHERE method = 'phash_burst' GROUP BY project_id
""")
def group_summary(spark, d):
    groups, members = _tables(spark, d, "similar_groups", "group_members")
    return records.group_summary(groups, members, similarity.METHOD)


# --- browsing ----------------------------------------------------------------------------------------------------------

_BROWSE = """
shown AS (SELECT DISTINCT id AS photo_id, project_id AS p, shot_at, CASE WHEN NOT isnan(blur_score) THEN blur_score END AS blur_score FROM photos),
bursts AS (SELECT DISTINCT id AS group_id, project_id FROM similar_groups WHERE method = 'phash_burst'),
members AS (SELECT DISTINCT group_id, photo_id FROM group_members),
inside AS (SELECT project_id, group_id, photo_id, shot_at, blur_score FROM members JOIN bursts USING (group_id) JOIN shown USING (photo_id)),
firsts AS (SELECT project_id, group_id, row_number() OVER (PARTITION BY project_id ORDER BY min(shot_at) NULLS LAST, group_id) AS group_pos FROM inside GROUP BY project_id, group_id),
browsed AS (SELECT project_id, group_pos, row_number() OVER (PARTITION BY group_id ORDER BY shot_at NULLS LAST, blur_score DESC NULLS LAST, photo_id) AS pos,
  group_id, photo_id, shot_at, blur_score FROM inside JOIN firsts USING (project_id, group_id))
"""


@query(f"WITH {_BROWSE} SELECT project_id, group_pos, pos, group_id, photo_id, shot_at, blur_score FROM browsed")
def browse_grouped(spark, d):
    return browse.browse_grouped(*_tables(spark, d, "group_members", "photos", "similar_groups"))


@query(f"""
WITH {_BROWSE}
SELECT p AS project_id, row_number() OVER (PARTITION BY p ORDER BY shot_at NULLS LAST, blur_score DESC NULLS LAST, photo_id) AS pos, photo_id, shot_at, blur_score
FROM shown s WHERE NOT EXISTS (SELECT 1 FROM members m JOIN bursts USING (group_id) WHERE m.photo_id = s.photo_id)
""")
def browse_ungrouped(spark, d):
    return browse.browse_ungrouped(*_tables(spark, d, "group_members", "photos", "similar_groups"))


@query(f"WITH {_BROWSE} SELECT group_id, photo_id, coalesce(lead(photo_id) OVER w, first_value(photo_id) OVER w) AS next_id FROM browsed WINDOW w AS (PARTITION BY group_id ORDER BY pos)")
def compare_next(spark, d):
    return browse.compare_next(*_tables(spark, d, "group_members", "photos", "similar_groups"))


@query(f"""
WITH {_BROWSE}, marked AS (SELECT p, photo_id, bool_or(g) AS g FROM (
  SELECT DISTINCT s.p, s.photo_id, i.photo_id IS NOT NULL AS g FROM (SELECT DISTINCT id AS photo_id, project_id AS p FROM photos) s LEFT JOIN inside i ON s.photo_id = i.photo_id) GROUP BY ALL)
SELECT p AS project_id, count(*) AS n_photos, count(*) FILTER (g) AS n_grouped, count(*) FILTER (NOT g) AS n_ungrouped, 0::BIGINT AS n_both FROM marked GROUP BY p
""")
def browse_partition_check(spark, d):
    return browse.partition_check(*_tables(spark, d, "group_members", "photos", "similar_groups"))


@query(f"WITH {_BROWSE} SELECT group_id, min(shot_at) AS earliest, count(*) AS n FROM inside GROUP BY group_id")
def group_earliest(spark, d):
    rows = browse.grouped(*_tables(spark, d, "group_members", "photos", "similar_groups"))
    return rows.groupBy("group_id").agg(F.min("shot_at").alias("earliest"), F.count("*").alias("n"))


# --- records ------------------------------------------------------------------------------------------------------------


@query("""
WITH n AS (SELECT project_id, count(DISTINCT id) AS n FROM photos GROUP BY project_id)
SELECT row_number() OVER (ORDER BY last_opened_at DESC NULLS LAST, created_at DESC, id) AS pos, id, name, created_at, last_opened_at, coalesce(n, 0) AS photo_count
FROM projects LEFT JOIN n ON id = project_id
""")
def project_list(spark, d):
    return records.project_list(*_tables(spark, d, "projects", "photos"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def status_latest(spark, d):
    return records.latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "value"])


_CLICKS = "SELECT id, CASE WHEN length(path) % 3 = 0 THEN 'keep' WHEN length(path) % 3 = 1 THEN 'reject' ELSE 'unknown' END AS status FROM photos WHERE analysis_state = 'done'"


@query(f"WITH clicks AS (SELECT DISTINCT * FROM ({_CLICKS}) WHERE status <> 'unknown') SELECT p.id, coalesce(c.status, p.status) AS status FROM photos p LEFT JOIN clicks c ON p.id = c.id")
def status_applied(spark, d):
    photos = table(spark, d, "photos")
    n = F.length("path") % 3
    clicks = photos.where("analysis_state = 'done'").select("id", F.lit(1).alias("seq"), F.when(n == 0, "keep").when(n == 1, "reject").otherwise("unknown").alias("status"))
    return records.with_status(photos, clicks).select("id", "status")


@query("""
WITH o AS (SELECT DISTINCT id, length(path) % 2 = 0 AS ok FROM photos WHERE analysis_state = 'pending')
SELECT p.id, CASE WHEN ok THEN 'done' WHEN NOT ok THEN 'failed' ELSE analysis_state END AS analysis_state,
  CASE WHEN ok THEN NULL WHEN NOT ok THEN 'ValueError: unreadable' ELSE analysis_error END AS analysis_error,
  CASE WHEN ok THEN 'ffff0000ffff0000' ELSE phash END AS phash
FROM photos p LEFT JOIN o ON p.id = o.id
""")
def analysis_merge(spark, d):
    photos = table(spark, d, "photos")
    pending = photos.where("analysis_state = 'pending'").distinct()
    made = {"shot_at": "2026-01-01T00:00:00", "blur_score": 120.5, "is_blurry": False, "exposure_score": 0.5, "exposure_flag": "normal", "phash": "ffff0000ffff0000"}
    outcomes = pending.select("id", (F.length("path") % 2 == 0).alias("ok"), *[F.lit(v).alias(k) for k, v in made.items()], F.lit("ValueError: unreadable").alias("error"))
    return records.with_analysis(photos, outcomes).select("id", "analysis_state", "analysis_error", "phash")


@query("""
SELECT project_id, count(*) FILTER (analysis_state = 'done') AS analyzed, count(*) FILTER (analysis_state = 'failed') AS failed, count(*) FILTER (analysis_state = 'pending') AS pending
FROM (SELECT DISTINCT id, project_id, analysis_state FROM photos) GROUP BY project_id
""")
def analyze_summary(spark, d):
    return records.analysis_summary(table(spark, d, "photos"))


_CASCADE = """
gone AS (SELECT id FROM projects WHERE last_opened_at IS NULL),
m AS (SELECT gm.* FROM group_members gm WHERE group_id NOT IN (SELECT id FROM similar_groups WHERE project_id IN (FROM gone)) AND photo_id NOT IN (SELECT id FROM photos WHERE project_id IN (FROM gone)))
"""


@query(f"""
WITH {_CASCADE}
SELECT 'projects' AS name, (SELECT count(*) FROM projects WHERE id NOT IN (FROM gone)) AS n
UNION ALL SELECT 'photos', (SELECT count(*) FROM photos WHERE project_id NOT IN (FROM gone))
UNION ALL SELECT 'similar_groups', (SELECT count(*) FROM similar_groups WHERE project_id NOT IN (FROM gone))
UNION ALL SELECT 'group_members', (SELECT count(*) FROM m)
""")
def cascade_delete(spark, d):
    projects, photos, groups, members = _tables(spark, d, "projects", "photos", "similar_groups", "group_members")
    left = records.cascade(projects.where("last_opened_at IS NULL").select("id"), projects, photos, groups, members)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_PLANNED = r"""
keeps AS (SELECT DISTINCT project_id AS dest, id, path, nullif(regexp_extract(path, '([^/\\]*)$', 1), '') AS name FROM photos WHERE status = 'keep'),
planned AS (SELECT *, row_number() OVER (PARTITION BY dest, name ORDER BY id) - 1 AS n FROM keeps)
"""


@query(f"""
WITH {_PLANNED}
SELECT dest, id, path, name, CASE WHEN n = 0 THEN name ELSE regexp_replace(name, '^(.+?)(\\.[^.]*)?$', '\\1 (' || n || ')\\2') END AS target, CASE WHEN n = 0 THEN 'exported' ELSE 'renamed' END AS outcome
FROM planned
""")
def export_plan(spark, d):
    keeps = table(spark, d, "photos").where("status = 'keep'").select(F.col("project_id").alias("dest"), "id", "path")
    nothing = spark.createDataFrame([], "dest string, name string")
    return export.export_plan(keeps, nothing).select("dest", "id", "path", "name", "target", "outcome")


_MIXED = "CASE WHEN n < 6 THEN 'shot.jpg' WHEN n < 9 THEN 'shot (' || (n - 5) || ').jpg' WHEN n = 9 THEN 'shot' WHEN n = 10 THEN 'shot (2)' ELSE 'shot (1) (1).jpg' END"


@query(rf"""
WITH keeps AS (SELECT DISTINCT project_id AS dest, id, ascii(id) % 12 AS n FROM photos),
named AS (SELECT dest, id, {_MIXED} AS name FROM keeps),
there AS (SELECT id AS dest, unnest(['shot (2).jpg', 'shot', 'shot (5).jpg']) AS name FROM projects),
known AS (SELECT dest, name FROM named UNION SELECT dest, name FROM there),
forms AS (SELECT dest, regexp_replace(name, '^(.+) \((\d+)\)(\.[^.]*)?$', '\1\3') AS name, regexp_extract(name, '^(.+) \((\d+)\)(\.[^.]*)?$', 2)::INT AS k FROM known WHERE regexp_matches(name, '^(.+) \((\d+)\)(\.[^.]*)?$')),
blocked AS (SELECT dest, name, list_sort(list(DISTINCT k)) AS taken FROM forms GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY dest, name ORDER BY id) - 1 + ((dest, name) IN (FROM there))::INT AS r FROM named),
placed AS (SELECT dest, id, name, CASE WHEN r = 0 THEN 0 ELSE r + len(list_filter(coalesce(taken, []), lambda x, i: x - (i - 1) <= r)) END AS k FROM ranked LEFT JOIN blocked USING (dest, name))
SELECT dest, id, name, CASE WHEN k > 9999 THEN NULL WHEN k = 0 THEN name ELSE regexp_replace(name, '^(.+?)(\.[^.]*)?$', '\1 (' || k || ')\2') END AS target, CASE WHEN k > 9999 THEN 'failed' WHEN k = 0 THEN 'exported' ELSE 'renamed' END AS outcome FROM placed
""")
def export_numbered(spark, d):
    """Names of which some are numbered forms of others, in folders where some are taken."""
    photos = table(spark, d, "photos").select(F.col("project_id").alias("dest"), "id", (F.ascii("id") % 12).alias("n"))
    keeps = photos.select("dest", "id", F.expr(f"concat('/x/', {_MIXED})").alias("path"))
    there = table(spark, d, "projects").select(F.col("id").alias("dest"), F.explode(F.array(*map(F.lit, ("shot (2).jpg", "shot", "shot (5).jpg")))).alias("name"))
    return export.export_plan(keeps, there).select("dest", "id", "name", "target", "outcome")


@query(f"WITH {_PLANNED} SELECT dest, count(*) AS exported, count(*) FILTER (n > 0) AS renamed, 0::BIGINT AS skipped, 0::BIGINT AS failed FROM planned GROUP BY dest")
def export_summary(spark, d):
    keeps = table(spark, d, "photos").where("status = 'keep'").select(F.col("project_id").alias("dest"), "id", "path")
    return export.export_summary(export.export_plan(keeps, spark.createDataFrame([], "dest string, name string")))


# --- files, images and streams ---------------------------------------------------------------------------------------------


def _folder(stash: Stash) -> str:
    """The stash's own folder, as a path on the file system that all executors share."""
    return stash.root.removeprefix("file://").removeprefix("file:")


def _file_tree(spark, d):
    """Files below a folder of their own, one for each project: in a folder by the length of its name, of as many bytes, with one of three endings."""
    stash = Stash(spark, "files")
    root = _folder(stash)
    ship(spark)

    def make(batches):
        import os

        for b in batches:
            for i, n in zip(b["id"].to_pylist(), b["n"].to_pylist()):
                os.makedirs(f"{root}/in/{n}", exist_ok=True)
                with open(f"{root}/in/{n}/{i}{('.jpg', '.PNG', '.txt')[n % 3]}", "wb") as f:
                    f.write(b"x" * n)
            yield b

    stash.put(table(spark, d, "projects").select("id", F.length("name").alias("n")).mapInArrow(make, "id string, n int"))
    return root


_FILES = "files AS (SELECT id, length(name) AS n, length(name) || '/' || id || CASE length(name) % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' ELSE '.txt' END AS file FROM projects)"


@query(f"WITH {_FILES} SELECT file, n AS size, n % 3 < 2 AS taken FROM files")
def media_scan(spark, d):
    root = _file_tree(spark, d)
    return media_files(spark, f"{root}/in").select(F.substring("path", len(f"{root}/in/") + 1, 1 << 30).alias("file"), "size", P.is_supported(F.col("path")).alias("taken"))


@query("SELECT count(*) AS found, 0::BIGINT AS skipped FROM projects")
def scan_summary(spark, d):
    return media_scan_summary(media_files(spark, f"{_file_tree(spark, d)}/in"))


@query(f"""
WITH {_FILES}, kept AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY id) - 1 AS k FROM files WHERE n % 3 < 2)
SELECT n || CASE WHEN k = 0 THEN '' ELSE ' (' || k || ')' END || CASE n % 3 WHEN 0 THEN '.jpg' ELSE '.PNG' END AS name, n AS size FROM kept
""")
def exported_files(spark, d):
    """What lies in a folder after files of equal names were copied there."""
    import os

    root = _file_tree(spark, d)
    os.makedirs(f"{root}/out")
    stash = Stash(spark, "exported")
    size = F.length("name").cast("string")
    source = F.concat(F.lit(f"{root}/in/"), size, F.lit("/"), F.col("id"))
    ending = F.when(F.length("name") % 3 == 0, ".jpg").otherwise(".PNG")
    keeps = table(spark, d, "projects").where(F.length("name") % 3 < 2).select(F.lit(f"{root}/out").alias("dest"), "id", F.concat(source, ending).alias("path"), F.concat(size, ending).alias("as"))
    plan = export.export_plan(keeps.select("dest", "id", F.concat(F.lit("/"), "as").alias("path")), spark.createDataFrame([], "dest string, name string"))
    found = plan.drop("path").join(keeps.select("id", "path"), "id").select("dest", "id", "path", "name", "target", "outcome", "error")
    stash.put(export.copy_planned(found))
    there = media_files(spark, f"{root}/out")
    return there.select(P.file_name(F.col("path")).alias("name"), "size")


def _pictures(rows, key: str, levels, colours: int = 1):
    """(id, content): a PNG for each row of (key, w, h), whose level at x and y is levels(key, x, y), for each colour with the key one more."""
    import numpy as np
    import pandas as pd

    from ..sources.images import encode_png

    ship(rows.sparkSession)

    def draw(batches):
        for pdf in batches:
            content = []
            for k, w, h in zip(pdf[key], pdf["w"], pdf["h"]):
                y, x = np.mgrid[:h, :w]
                planes = [np.clip(levels(int(k) + c, x, y), 0, 255).astype(np.uint8) for c in range(colours)]
                content.append(encode_png(planes[0] if colours == 1 else np.stack(planes, 2)))
            yield pd.DataFrame({"id": pdf[key].astype(str).astype(object), "content": pd.Series(content, dtype=object)})

    return rows.mapInPandas(draw, "id string, content binary")


def _noise(k, x, y):
    """Levels around a tone that depends on the key, of a contrast that does too."""
    most = k % 50 * 4 + 4
    return k * 37 % 256 + (x * x * x * 29 + y * y * 13 + x * y * (k % 7 + 1) + k) % 1009 % (most + 1) - most // 2


_LEVEL = "least(255, greatest(0, {k} * 37 % 256 + (x * x * x * 29 + y * y * 13 + x * y * ({k} % 7 + 1) + {k}) % 1009 % ({k} % 50 * 4 + 5) - ({k} % 50 * 4 + 4) // 2))"
_SHARP = """
pixel AS (SELECT k, w, h, x, y, {level} AS s FROM sized, range(w) a(x), range(h) b(y)),
around AS (SELECT *, lag(s) OVER row + lead(s) OVER row + lag(s) OVER col + lead(s) OVER col - 4 * s AS response FROM pixel
  WINDOW row AS (PARTITION BY k, y ORDER BY x), col AS (PARTITION BY k, x ORDER BY y)),
features AS (SELECT k, any_value(w) AS w, any_value(h) AS h, coalesce(var_pop(response), 0) AS blur, avg(s) / 255 AS mean, avg((s >= 250)::INT) AS bright, avg((s <= 5)::INT) AS dark FROM around GROUP BY k),
flagged AS (SELECT *, CASE WHEN mean > 0.8 OR bright >= 0.5 THEN 'over' WHEN mean < 0.2 OR dark >= 0.5 THEN 'under' ELSE 'normal' END AS flag FROM features)
"""


@query(f"""
WITH sized AS (SELECT p_partkey AS k, 32 AS w, 32 AS h FROM part), {_SHARP.format(level=_LEVEL.format(k="k"))},
waves AS (SELECT u, z, cos(pi() * u * (2 * z + 1) / 64) AS c FROM range(8) a(u), range(32) b(z)),
rows_ AS (SELECT k, y, u AS v, sum(s * c) AS r FROM pixel JOIN waves ON x = z GROUP BY ALL),
low AS (SELECT k, u, v, sum(r * c) AS f FROM rows_ JOIN waves ON y = z GROUP BY ALL),
bits AS (SELECT k, u, v, (f > median(f) OVER (PARTITION BY k))::INT AS bit FROM low),
nibbles AS (SELECT k, u, v // 4 AS n, sum(bit << (3 - v % 4))::INT AS x FROM bits GROUP BY ALL),
hashes AS (SELECT k, string_agg(substr('0123456789abcdef', x + 1, 1), '' ORDER BY u, n) AS phash FROM nibbles GROUP BY k)
SELECT k::VARCHAR AS id, true AS ok, NULL::VARCHAR AS shot_at, round(blur, 6) AS blur_score, blur < 100 AS is_blurry, round(mean, 9) AS exposure_score, flag AS exposure_flag, phash, NULL::VARCHAR AS error
FROM flagged JOIN hashes USING (k)
""")
def image_features(spark, d):
    """All features of pictures drawn from the parts, encoded and decoded again."""
    made = analyse(_pictures(table(spark, d, "part").select("p_partkey", F.lit(32).alias("w"), F.lit(32).alias("h")), "p_partkey", _noise))
    return made.withColumns({"blur_score": F.round("blur_score", 6), "exposure_score": F.round("exposure_score", 9)})


@query(f"""
WITH sized AS (SELECT s_suppkey AS k, s_suppkey % 9 + 1 AS w, s_suppkey % 7 + 1 AS h FROM supplier), {_SHARP.format(level=_LEVEL.format(k="k"))}
SELECT k::VARCHAR AS id, round(CASE WHEN least(w, h) < 3 THEN 0 ELSE blur END, 6) AS blur_score, least(w, h) < 3 OR blur < 400 AS is_blurry FROM flagged
""")
def blur_variance(spark, d):
    """Sharpness of pictures of all small sizes, some too small to have any, by a threshold of the caller's."""
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 9 + 1).cast("int").alias("w"), (F.col("s_suppkey") % 7 + 1).cast("int").alias("h"))
    return analyse(_pictures(rows, "s_suppkey", _noise), blur_threshold=400.0).select("id", F.round("blur_score", 6).alias("blur_score"), "is_blurry")


def _tones(k, x, y):
    """Even red and blue, odd green: no grey level is then halfway between two."""
    return (k * 52 + x * 22 + y * 6) % 256 // 2 * 2 + k % 2


_TONE = "(({k} * 52 + x * 22 + y * 6) % 256 // 2 * 2 + {k} % 2)"
_GREY = f"floor(0.299 * {_TONE.format(k='k')} + 0.587 * {_TONE.format(k='(k + 1)')} + 0.114 * {_TONE.format(k='(k + 2)')} + 0.5)::INT"


@query(f"""
WITH sized AS (SELECT c_custkey * 2 AS k, 9 AS w, 6 AS h FROM customer), {_SHARP.format(level=_GREY)}
SELECT k::VARCHAR AS id, round(mean, 9) AS exposure_score, CASE WHEN mean > 0.55 OR bright >= 0.2 THEN 'over' WHEN mean < 0.45 OR dark >= 0.2 THEN 'under' ELSE 'normal' END AS exposure_flag FROM features
""")
def exposure_shares(spark, d):
    """Exposure of coloured pictures, by thresholds of the caller's."""
    rows = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("k"), F.lit(9).alias("w"), F.lit(6).alias("h"))
    made = analyse(_pictures(rows, "k", _tones, 3), over_mean=0.55, under_mean=0.45, clip_ratio=0.2)
    return made.select("id", F.round("exposure_score", 9).alias("exposure_score"), "exposure_flag")


@query("""
WITH s AS (SELECT s_suppkey AS id, s_suppkey % 40 + 1 AS w, s_suppkey % 23 + 1 AS h FROM supplier), t AS (SELECT *, 16.0::DOUBLE / greatest(w, h) AS scale FROM s)
SELECT id::VARCHAR AS id, CASE WHEN greatest(w, h) <= 16 THEN w ELSE greatest(1, round_even(w * scale, 0)) END::INT AS width, CASE WHEN greatest(w, h) <= 16 THEN h ELSE greatest(1, round_even(h * scale, 0)) END::INT AS height,
  NULL::VARCHAR AS error FROM t
""")
def transcoded(spark, d):
    """Sizes of reduced copies, read from the files that were written."""
    stash = Stash(spark, "transcoded")
    root = _folder(stash)
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 40 + 1).cast("int").alias("w"), (F.col("s_suppkey") % 23 + 1).cast("int").alias("h"))
    drawn = _pictures(rows, "s_suppkey", _noise)

    def save(batches):
        import os

        os.makedirs(f"{root}/in", exist_ok=True)
        for b in batches:
            for i, content in zip(b["id"].to_pylist(), b["content"].to_pylist()):
                with open(f"{root}/in/{i}.png", "wb") as f:
                    f.write(content)
            yield b.select(["id"])

    saved = stash.put(drawn.mapInArrow(save, "id string"))
    files = saved.select("id", F.concat(F.lit(f"{root}/in/"), "id", F.lit(".png")).alias("path"), F.lit(1).cast("bigint").alias("mtime_ns"))
    done = stash.put(transcode(files, f"{root}/out", 16, "png"))

    def sizes(batches):
        from ..sources.images import decode

        for b in batches:
            shapes = []
            for path in b["dest"].to_pylist():
                with open(path, "rb") as f:
                    shapes.append(decode(f.read()).shape)
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([s[1] for s in shapes], pa.int32()), pa.array([s[0] for s in shapes], pa.int32()), b["error"]], names=["id", "width", "height", "error"])

    return done.mapInArrow(sizes, "id string, width int, height int, error string")


@query("""
SELECT n_nationkey, CASE WHEN n_nationkey % 3 < 2 THEN n_name END AS answer, CASE n_nationkey % 3 WHEN 2 THEN 'ValueError: unknown op nothing' END AS error FROM nation
""")
def rpc_responses(spark, d):
    """Answers to requests in JSON lines, two of three of which can be met."""
    op = F.when(F.col("n_nationkey") % 3 < 2, "echo").otherwise("nothing")
    asked = table(spark, d, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("id"), op.alias("op"), F.struct(F.col("n_name").alias("text")).alias("payload"))).alias("line"))
    ship(spark)

    def answer(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([respond(x) for x in b["line"].to_pylist()])], names=["line"])

    got = asked.mapInArrow(answer, "line string").select(F.from_json("line", "id int, result string, error string").alias("r"))
    return got.select(F.col("r.id").alias("n_nationkey"), F.col("r.result").alias("answer"), F.col("r.error").alias("error"))


@query("""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL
""")
def streamed_counts(spark, d):
    """Hourly counts by event time, taken by a stream that reads the events and ends with them."""
    stash = Stash(spark, "streamed")
    rows = stash.put(table(spark, d, "events").select(F.to_timestamp("ts").alias("at"), F.col("event_type").alias("status")))
    counts = status_counts(spark.readStream.schema(rows.schema).parquet(rows._stash_path), "365 days", "1 hour")
    out = f"{stash.root}/counts"

    def keep(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/{n}")

    done = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{stash.root}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    last = done.lastProgress["batchId"] if done.lastProgress else 0
    whole = spark.read.parquet(f"{out}/{last}")
    return whole.select(F.to_timestamp_ntz(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")).alias("hour"), F.col("status").alias("event_type"), "n")


# --- further shapes of the browse model and single functions -------------------------------------------------------------


@query(f"WITH {_BROWSE} SELECT project_id, group_pos, group_id, string_agg(photo_id, ',' ORDER BY pos) AS photos FROM browsed GROUP BY ALL")
def browse_model(spark, d):
    nested = browse.browse_model(*_tables(spark, d, "group_members", "photos", "similar_groups"))
    return nested.withColumn("photos", F.array_join("photos", ","))


@query(f"WITH {_BROWSE} SELECT group_id, photo_id, 'Group ' || group_pos AS title, (pos - 1) // 4 AS shelf, (pos - 1) % 4 AS slot FROM browsed")
def group_shelves(spark, d):
    """Display rows of four photos under the group's numbered title."""
    rows = browse.browse_grouped(*_tables(spark, d, "group_members", "photos", "similar_groups"))
    at = F.col("pos") - 1
    return rows.select("group_id", "photo_id", F.concat(F.lit("Group "), F.col("group_pos").cast("string")).alias("title"), F.expr("(pos - 1) div 4").alias("shelf"), (at % 4).alias("slot"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber % 2 <> 0 END AS flag FROM lineitem")
def int_to_bool(spark, d):
    n = F.when(F.col("l_linenumber") != 3, F.col("l_linenumber") % 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.int_to_bool(n).alias("flag"))


def _exif_file(text: str, form: int) -> bytes:
    """A file of one of four forms whose EXIF block holds the capture time, in a sub-directory, or the change time alone."""
    import struct

    raw = text.encode() + b"\0"
    if form % 2:
        block = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + bytes(4) + struct.pack("<H", 1) + struct.pack("<HHII", 0x9003, 2, len(raw), 44) + bytes(4) + raw
    else:
        block = b"MM\0*" + struct.pack(">IH", 8, 1) + struct.pack(">HHII", 0x0132, 2, len(raw), 26) + bytes(4) + raw
    if form < 2:
        other = b"\xff\xe2" + struct.pack(">H", 302) + bytes(300)
        return b"\xff\xd8" + other + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xd9"
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + bytes(4)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", bytes(100)) + chunk(b"eXIf", block)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS shot_at FROM orders")
def exif_times(spark, d):
    """Capture times read from files that hold each order's time, or a broken one, as EXIF."""
    text = F.when(F.col("o_orderkey") % 7 == 0, "0000:00:00 00:00:00").otherwise(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"))
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("text"))

    ship(spark)

    def read(batches):
        for b in batches:
            files = [_exif_file(t, k % 4) for k, t in zip(b["o_orderkey"].to_pylist(), b["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["o_orderkey"], pa.array([shot_at(f) for f in files], pa.string())], names=["o_orderkey", "shot_at"])

    return rows.mapInArrow(read, "o_orderkey bigint, shot_at string")


@query(f"""
WITH RECURSIVE {_GROUPS}
SELECT project_id, method, count(*) AS n FROM (SELECT project_id, 'phash_burst' AS method FROM ids UNION ALL SELECT project_id, method FROM (SELECT DISTINCT id, project_id, method FROM similar_groups WHERE method <> 'phash_burst')) GROUP BY ALL
""")
def groups_after_regroup(spark, d):
    """Regrouping replaces the groups of its own method alone."""
    groups, _ = similarity.regrouped(table(spark, d, "photos"))
    kept = table(spark, d, "similar_groups").where(F.col("method") != similarity.METHOD).select("id", "project_id", "method").distinct()
    return groups.select("id", "project_id", "method").unionByName(kept).groupBy("project_id", "method").agg(F.count("*").alias("n"))
