"""Small tables with every awkward case, and plain versions of the operators to compare with."""

import datetime as dt
import hashlib
import random

PHOTOS = "id string, project_id string, path string, status string, created_at string, shot_at string, blur_score double, is_blurry boolean, exposure_score double, exposure_flag string, phash string, analysis_state string, analysis_error string"
SETTINGS = "project_id string, tz_name string, date_order string, keep_permille int"
GROUPS = "id string, project_id string, method string, params string"
MEMBERS = "group_id string, photo_id string"
#: Columns that operators might use inside.
CLASHES = ["k", "g", "n", "c", "h", "t", "u", "v", "sub", "rank", "count", "score", "source", "code", "slot", "kind", "zone_name", "zone_codes", "shot_micros", "stats", "tokens", "salt", "size", "__sub"]


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in CLASHES if c not in df.columns})


def random_tables(seed, n=300):
    """photos, settings, groups, members as row lists: nulls everywhere, odd ids, ties, repeated rows, copies of hashes."""
    r = random.Random(seed)
    ids = [sha((seed, i)) for i in range(n)] + ["", "a", "0" * 31, "0" * 32, "f" * 64, "F" * 64, "ü" * 40]
    base = [r.getrandbits(64) for _ in range(6)]
    t0 = dt.datetime(2024, 5, 1, 12)
    photos = []
    for i in ids:
        h = r.choice(base)
        for _ in range(r.choice([0, 0, 1, 3, 5, 9])):
            h ^= 1 << r.randrange(64)
        at = t0 + dt.timedelta(seconds=r.choice([0, 0, r.randrange(4000), r.randrange(200000)]))
        photos.append((
            i, r.choice(["p1", "p1", "p1", "p2", "nosettings", None]), r.choice([None, "/x/a.jpg"]), r.choice(["keep", None]),
            r.choice([None, "bad", str(at) + "+00:00", at.isoformat() + "Z", "1714567890"]), r.choice([None, "--", at.isoformat(), at.isoformat(), at.strftime("%Y:%m:%d %H:%M:%S")]),
            r.choice([None, float("nan"), -1.0, 0.0, -0.0, 5.0, 5.0, 7.25, float("inf"), r.random() * 1000]), None, r.choice([None, 0.5, float("nan")]),
            r.choice([None, "normal", " Over\t", "under", "?"]), r.choice([None, "", f"{h:016x}", f"{h:016X}", f"{h:016x}", "z" * 16, f"{h:016x} "]), r.choice(["done", "done", "failed", None]), None,
        ))
    photos += [(None, "p1", None, None, None, "2024-05-01T12:00:00", 9.0, None, None, None, "0" * 16, "done", None)]
    photos += r.sample(photos, 40)
    settings = [("p1", "Europe/Berlin", "dmy", 333), ("p2", "Mars/Base", None, 1000), ("p2", "Mars/Base", None, 1000), (None, "UTC", "dmy", 5), ("empty", "UTC", "mdy", 100)]
    groups = [(sha(("g", i)), "p1", m, "{}") for i, m in enumerate(["phash_burst", "import_match", "album", None, "phash_burst"] * 8)] + [(None, "p1", "phash_burst", None), ("lone", None, "phash_burst", "x")]
    members = [(r.choice(groups)[0], r.choice(ids)) for _ in range(n)] + [("lone", "gone"), (None, ids[0]), ("lone", None), ("nogroup", ids[1])]
    members += r.sample(members, 30)
    members += [(groups[0][0], i) for i in ids[: n // 3]]
    return photos, settings, groups, members


def frames(spark, seed=1, n=300):
    rows = random_tables(seed, n)
    made = [spark.createDataFrame(x, s) for x, s in zip(rows, (PHOTOS, SETTINGS, GROUPS, MEMBERS))]
    return [with_clashes(df) for df in made], rows


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def roots(pairs):
    """Components by union-find: member -> smallest member."""
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}
