"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from ..plans.instants_sql import INSTANTS
from ..runtime import Stash, table
from .components import photo_components
from .cutoffs import cutoffs_after_batches, kept_photos, project_cutoffs
from .encoding import count_tokens, encode_texts
from .near_pairs import near_duplicates
from .packing import fill_report, pack
from .quality import text_quality, text_shapes
from .survivors import group_skyline, group_survivors
from .top_n import top_members

#: Methods whose groups hold duplicates.
DUPLICATES = ("phash_burst", "import_match")

QUERIES = {}
ORACLE = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, d):
    return near_duplicates(table(spark, d, "photos"), table(spark, d, "project_settings"))


@query
def p1_overfull(spark, d):
    """The same pairs with a tiny limit of rows a slot, so that the routing tree and the blocks, which only overfull slots need, do the work."""
    return near_duplicates(table(spark, d, "photos"), table(spark, d, "project_settings"), shard_rows=20)


_PAIRS = f"""
{INSTANTS},
digits AS (SELECT DISTINCT id, project_id, list_transform(string_split(lower(phash), ''), lambda c: (instr('0123456789abcdef', c) - 1)::UBIGINT) AS x FROM photos WHERE regexp_full_match(phash, '[0-9a-fA-F]{{16}}')),
points AS (SELECT id, project_id, list_reduce(x, lambda a, e: (a << 4) | e) AS h, utc_micros AS t FROM digits JOIN instants ON photo_id = id AND field = 'shot_at'),
pairs AS (SELECT a.id AS photo_a, b.id AS photo_b FROM points a JOIN points b ON a.project_id = b.project_id AND a.id < b.id AND bit_count(xor(a.h, b.h)) <= 8 AND abs(a.t - b.t) <= 600000000)
"""
ORACLE["p1_found"] = ORACLE["p1_overfull"] = f"WITH {_PAIRS} SELECT photo_a, photo_b FROM pairs"
_OF_DUPLICATES = """
kept AS (SELECT id AS g FROM similar_groups WHERE method IN ('phash_burst', 'import_match')),
inside AS (SELECT DISTINCT group_id, photo_id FROM group_members WHERE group_id IN (FROM kept))
"""
ORACLE["p5_found"] = f"""
WITH RECURSIVE {_PAIRS}, {_OF_DUPLICATES},
firsts AS (SELECT group_id, min(photo_id) AS first FROM inside GROUP BY group_id),
links AS (SELECT photo_a AS a, photo_b AS b FROM pairs UNION SELECT first, photo_id FROM inside JOIN firsts USING (group_id) WHERE first <> photo_id),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS root FROM edges UNION SELECT e.b, r.root FROM reach r JOIN edges e ON r.id = e.a WHERE r.root < e.b)
SELECT min(root) AS component_id, id AS photo_id FROM reach GROUP BY id
"""


@query
def p5_found(spark, d):
    photos, settings, groups, members = (table(spark, d, x) for x in ("photos", "project_settings", "similar_groups", "group_members"))
    return photo_components(photos, settings, groups, members, DUPLICATES)


@query
def p3_found(spark, d):
    return kept_photos(table(spark, d, "photos"), table(spark, d, "project_settings"))


@query
def p3_cutoffs(spark, d):
    cut = project_cutoffs(table(spark, d, "photos"), table(spark, d, "project_settings"))
    return cut.withColumnRenamed("source", "project_id")


@query
def p3_batches(spark, d):
    """The same cutoffs from a persistent tree that takes in the undecided photos first and the decided ones as a second batch."""
    photos = table(spark, d, "photos")
    undecided = photos.status.eqNullSafe("pending")
    cut = cutoffs_after_batches([photos.where(undecided), photos.where(~undecided)], table(spark, d, "project_settings"), f"{Stash(spark, 'tree').root}/tree")
    return cut.withColumnRenamed("source", "project_id")


ORACLE["p3_cutoffs"] = ORACLE["p3_batches"] = """
WITH counted AS (
  SELECT DISTINCT id, project_id, blur_score FROM photos
  WHERE analysis_state = 'done' AND blur_score >= 0 AND NOT isnan(blur_score)
), ranked AS (
  SELECT project_id, blur_score, count(*) OVER (PARTITION BY project_id ORDER BY blur_score DESC) AS reach,
         count(*) OVER (PARTITION BY project_id) AS total
  FROM counted
)
SELECT project_id, max(blur_score) AS cutoff, min(reach) AS kept, max(total) AS total
FROM ranked JOIN project_settings USING (project_id)
WHERE reach * 1000 >= total * keep_permille
GROUP BY project_id
"""

ORACLE["p3_found"] = f"""
WITH cut AS ({ORACLE["p3_cutoffs"]})
SELECT DISTINCT project_id, id AS photo_id FROM photos JOIN cut USING (project_id)
WHERE analysis_state = 'done' AND blur_score >= cutoff AND NOT isnan(blur_score)
"""


@query
def p4_found(spark, d):
    return top_members(table(spark, d, "group_members"), table(spark, d, "photos")).select("group_id", "photo_id")


ORACLE["p4_found"] = """
WITH scored AS (SELECT id, max(CASE WHEN blur_score >= 0 AND NOT isnan(blur_score) THEN blur_score END) AS score FROM photos GROUP BY id),
members AS (SELECT DISTINCT group_id, photo_id FROM group_members),
ranked AS (
  SELECT group_id, photo_id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC NULLS LAST, photo_id) AS r
  FROM members LEFT JOIN scored ON id = photo_id
)
SELECT group_id, photo_id FROM ranked WHERE r <= 3
"""


@query
def p6_found(spark, d):
    members, groups, photos, settings = (table(spark, d, x) for x in ("group_members", "similar_groups", "photos", "project_settings"))
    return group_survivors(members, groups, photos, settings, DUPLICATES).select("group_id", "photo_id", "blur_from", "flag_from")


@query
def p6_skyline(spark, d):
    """The undominated members of every group of duplicates."""
    members, groups, photos, settings = (table(spark, d, x) for x in ("group_members", "similar_groups", "photos", "project_settings"))
    return group_skyline(members, groups, photos, settings, DUPLICATES)


@query
def p7_ids(spark, d):
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")


@query
def p8_pack(spark, d):
    return pack(count_tokens(table(spark, d, "documents"), "doc_id", "text"), table(spark, d, "pack_sizes"))


@query
def p8_fill(spark, d):
    return fill_report(p8_pack(spark, d), table(spark, d, "pack_sizes"))


@query
def p9_found(spark, d):
    return text_shapes(table(spark, d, "documents"), table(spark, d, "common_words"))


@query
def p9_stats(spark, d):
    return text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))


_RATED = f"""
{INSTANTS}, {_OF_DUPLICATES},
facts AS (
  SELECT DISTINCT id AS photo_id, coalesce(analysis_state = 'done', false)::INT AS done, CASE WHEN blur_score >= 0 AND NOT isnan(blur_score) THEN blur_score END AS score,
    coalesce(lower(regexp_replace(exposure_flag, '^\\s+|\\s+$', '', 'g')), '') AS flag, exposure_score IS NOT NULL AS exposed, coalesce(regexp_full_match(phash, '[0-9a-fA-F]{{16}}'), false) AS hashed
  FROM photos),
timed AS (SELECT f.*, s.utc_micros IS NOT NULL AS shot, c.utc_micros AS created FROM facts f
  LEFT JOIN instants s ON s.photo_id = f.photo_id AND s.field = 'shot_at' LEFT JOIN instants c ON c.photo_id = f.photo_id AND c.field = 'created_at'),
rated AS (SELECT group_id, t.*, flag IN ('normal', 'over', 'under') AS flagged,
  (score IS NOT NULL)::INT + exposed::INT + (flag IN ('normal', 'over', 'under'))::INT + hashed::INT + shot::INT AS complete FROM inside JOIN timed t USING (photo_id))
"""
ORACLE["p6_found"] = f"""
WITH {_RATED},
ranked AS (SELECT *,
  row_number() OVER (PARTITION BY group_id ORDER BY done DESC, complete DESC, flag = 'normal' DESC, score DESC NULLS LAST, created DESC NULLS LAST, photo_id) AS r,
  row_number() OVER (PARTITION BY group_id ORDER BY score IS NULL, done DESC, score DESC, photo_id) AS rb,
  row_number() OVER (PARTITION BY group_id ORDER BY NOT flagged, created DESC NULLS LAST, photo_id) AS rf FROM rated)
SELECT group_id, max(CASE WHEN r = 1 THEN photo_id END) AS photo_id, coalesce(max(CASE WHEN rb = 1 AND score IS NOT NULL THEN photo_id END), '') AS blur_from,
  coalesce(max(CASE WHEN rf = 1 AND flagged THEN photo_id END), '') AS flag_from
FROM ranked GROUP BY group_id
"""

#: Trust as one number, by rank in the group: done, then flag normal, then score.
ORACLE["p6_skyline"] = f"""
WITH {_RATED},
trusted AS (SELECT DISTINCT group_id, photo_id, complete, coalesce(created, -9223372036854775807) AS recent,
  dense_rank() OVER (PARTITION BY group_id ORDER BY done, flag = 'normal', coalesce(score, -1)) AS trust FROM rated)
SELECT group_id, photo_id FROM trusted x WHERE NOT EXISTS (
  SELECT 1 FROM trusted y WHERE y.group_id = x.group_id AND y.trust >= x.trust AND y.complete >= x.complete AND y.recent >= x.recent
    AND (y.trust > x.trust OR y.complete > x.complete OR y.recent > x.recent))
"""
