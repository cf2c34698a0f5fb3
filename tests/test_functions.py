import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from lumasieve.functions import photo as P
from lumasieve.functions.ids import pack_id, unpack_id
from lumasieve.operators.instants import photo_instants
from lumasieve.operators.ordinal import ordinal
from lumasieve.operators.records import latest
from lumasieve.operators.similarity import clusters, connected, near_hashes, regrouped
from lumasieve.runtime import Stash, scratch, work_dir

PHOTOS = "id string, project_id string, shot_at string, created_at string, k string, zone_name string, `__ts_p` string"
SETTINGS = "project_id string, tz_name string, date_order string, keep_permille int, id string"


def micros(*when, offset=0.0, us=0):
    return int((dt.datetime(*when) - dt.datetime(1970, 1, 1)).total_seconds() - offset * 3600) * 1_000_000 + us


# text, zone, order, instant of shot_at
SHOTS = [
    ("2024-05-01T12:30:15", "Europe/Berlin", "dmy", micros(2024, 5, 1, 12, 30, 15, offset=2)),
    ("2024:05:01 12:30:15", "Europe/Berlin", "dmy", micros(2024, 5, 1, 12, 30, 15, offset=2)),
    ("\t 2024/05/01 12:30  ", "Europe/Berlin", "dmy", micros(2024, 5, 1, 12, 30, offset=2)),
    ("2024-05-01T12:30:15,1234567", "UTC", "dmy", micros(2024, 5, 1, 12, 30, 15, us=123456)),
    ("2024-05-01 12:30:15.5+0530", "UTC", "dmy", micros(2024, 5, 1, 12, 30, 15, offset=5.5, us=500000)),
    ("2024-05-01T12:30:15-03:30", "UTC", "dmy", micros(2024, 5, 1, 12, 30, 15, offset=-3.5)),
    ("2024-05-01T12:30:15+02:00[Asia/Tokyo]", "UTC", "dmy", micros(2024, 5, 1, 12, 30, 15, offset=2)),
    ("2024-05-01T12:30:15[Asia/Tokyo]", "UTC", "dmy", micros(2024, 5, 1, 12, 30, 15, offset=9)),
    ("2024-05-01T12:30:15[Mars/Base]", "UTC", "dmy", None),
    ("01/02/2024 03:04:05", "UTC", "dmy", micros(2024, 2, 1, 3, 4, 5)),
    ("01/02/2024 03:04:05", "UTC", "mdy", micros(2024, 1, 2, 3, 4, 5)),
    ("1.2.2024 03:04", "UTC", "dmy", micros(2024, 2, 1, 3, 4)),
    ("12/31/2024 12:00:00 AM", "UTC", "mdy", micros(2024, 12, 31)),
    ("12/31/2024 12:59:00 PM", "UTC", "mdy", micros(2024, 12, 31, 12, 59)),
    ("12/31/2024 13:00:00 PM", "UTC", "mdy", None),
    ("31/31/2024 10:00", "UTC", "dmy", None),
    ("Fri, 03 May 2024 01:02:03 -0400", "UTC", "dmy", micros(2024, 5, 3, 1, 2, 3, offset=-4)),
    ("03 May 2024 01:02:03 +0100", "UTC", "dmy", micros(2024, 5, 3, 1, 2, 3, offset=1)),
    ("20240503T010203", "UTC", "dmy", micros(2024, 5, 3, 1, 2, 3)),
    ("20240503_010203+09:00", "UTC", "dmy", micros(2024, 5, 3, 1, 2, 3, offset=9)),
    ("2024-05-01 12:30:15 EDT", "America/New_York", "mdy", micros(2024, 5, 1, 12, 30, 15, offset=-4)),
    ("2024-05-01 12:30:15 EST", "America/New_York", "mdy", micros(2024, 5, 1, 12, 30, 15, offset=-5)),
    ("2024-05-01 12:30:15 IST", "Asia/Kolkata", "dmy", micros(2024, 5, 1, 12, 30, 15, offset=5.5)),
    ("2024-05-01 12:30:15 XYZ", "Asia/Kolkata", "dmy", None),
    ("2024-11-03T01:30:00", "America/New_York", "mdy", micros(2024, 11, 3, 1, 30, offset=-4)),
    ("2024-03-10T02:30:00", "America/New_York", "mdy", micros(2024, 3, 10, 2, 30, offset=-5)),
    ("1714567890", "Europe/Berlin", "dmy", 1714567890 * 1_000_000),
    ("1714567890123", "Europe/Berlin", "dmy", 1714567890123 * 1000),
    ("2024-02-30T10:00:00", "UTC", "dmy", None), ("2023-02-29T10:00:00", "UTC", "dmy", None), ("2024-02-29T10:00:00", "UTC", "dmy", micros(2024, 2, 29, 10)),
    ("1900-02-29T10:00:00", "UTC", "dmy", None), ("2000-02-29T10:00:00", "UTC", "dmy", micros(2000, 2, 29, 10)),
    ("0000:00:00 00:00:00", "UTC", "dmy", None), ("2024-05-01T24:00:00", "UTC", "dmy", None), ("2024-05-01T10:60:00", "UTC", "dmy", None), ("2024-05-01T10:00:60", "UTC", "dmy", None),
    ("2024-05-01", "UTC", "dmy", None), ("", "UTC", "dmy", None), ("--", "UTC", "dmy", None), (None, "UTC", "dmy", None), ("x" * 50_000, "UTC", "dmy", None),
    ("2024-05-01T10:00:00 and more", "UTC", "dmy", None), ("2024-05-01T10:00:00", None, None, None), ("2024-05-01T10:00:00", "No/Zone", None, None), ("2024-05-01T10:00:00Z", None, None, micros(2024, 5, 1, 10)),
]


def test_instants(spark):
    photos = [(f"i{i}", f"p{i}", text, None, "x", "x", "x") for i, (text, *_) in enumerate(SHOTS)]
    settings = [(f"p{i}", zone, order, 1, "x") for i, (_, zone, order, _) in enumerate(SHOTS)]
    df = spark.createDataFrame(photos + photos[:5] + [(None, "p0", "2024-05-01T12:30:15", None, "", "", "")], PHOTOS)
    got = {r.photo_id: r.utc_micros for r in photo_instants(df, spark.createDataFrame(settings + settings[:3], SETTINGS)).collect()}
    for i, (text, zone, order, want) in enumerate(SHOTS):
        assert got.get(f"i{i}") == want, (text, zone, order)


def test_created_is_utc_and_empty_tables(spark):
    photos = spark.createDataFrame([("a", "p", None, "2024-05-01 10:00:00", "", "", ""), ("b", None, None, "Wed, 01 May 2024 10:00:00 GMT", "", "", ""), ("c", "p", "bad", None, "", "", "")], PHOTOS)
    settings = spark.createDataFrame([("p", "Asia/Tokyo", "dmy", 1, "")], SETTINGS)
    want = {("a", "created_at", micros(2024, 5, 1, 10)), ("b", "created_at", micros(2024, 5, 1, 10))}
    assert {tuple(r) for r in photo_instants(photos, settings).collect()} == want
    assert photo_instants(photos.limit(0), settings.limit(0)).collect() == []
    assert {tuple(r) for r in photo_instants(photos, settings.limit(0)).collect()} == want


@pytest.mark.parametrize("zone", ["America/St_Johns", "Asia/Kathmandu", "Australia/Lord_Howe", "Europe/London"])
def test_every_hour_around_changes(spark, zone):
    texts = [(dt.datetime(2023, m, d, h, 30)).isoformat() for m in (3, 4, 10, 11) for d in range(1, 31) for h in range(0, 4)]
    photos = spark.createDataFrame([(t, "p", t, None, "", "", "") for t in texts], PHOTOS)
    got = {r.photo_id: r.utc_micros for r in photo_instants(photos, spark.createDataFrame([("p", zone, "dmy", 1, "")], SETTINGS)).collect()}
    for t in texts:
        offset = dt.datetime.fromisoformat(t).replace(tzinfo=zoneinfo.ZoneInfo(zone)).utcoffset()
        assert got[t] == (dt.datetime.fromisoformat(t) - offset - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def test_ids_round_trip(spark):
    texts = ["", "a", "ab", "f" * 64, "F" * 64, "0" * 30, "0" * 31, "0" * 32, "0" * 33, "é" * 16, "ü" * 15 + "x", "\x01\x02", "\x02" * 31, "x" * 1000, "g" * 64, "a" * 63]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").withColumn("k", pack_id(F.col("t"))).withColumn("b", unpack_id(F.col("k"))).collect()
    assert all(r.b == r.t for r in rows) and len({bytes(r.k) for r in rows if r.t is not None}) == len(texts)
    assert {len(r.k) for r in rows if r.t == "f" * 64} == {32}


def test_ordinal(spark):
    rows = [(g, i % 7, i) for g, n in ((None, 3), ("a", 500), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, x int, i int")
    order = [F.desc("x"), F.asc("i")]
    got = {(r.g, r.i): r.pos for r in ordinal(df.repartition(7), ["g"], order, "pos").collect()}
    for g in (None, "a", "b"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[g, r[2]] for r in own] == list(range(1, len(own) + 1))
    whole = sorted(rows, key=lambda r: (-r[1], r[2], r[0] or ""))
    flat = ordinal(df, [], [F.desc("x"), F.asc("i"), F.asc_nulls_first("g")], "pos").collect()
    assert [(r.g, r.i) for r in sorted(flat, key=lambda r: r.pos)] == [(r[0], r[2]) for r in whole]
    assert ordinal(df.limit(0), ["g"], order, "pos").collect() == []


def hashed(spark, *hexes, project="p"):
    return spark.createDataFrame([(f"{k}", project, h) for k, h in hexes], "id string, project_id string, phash string")


def test_clusters(spark):
    h = lambda x: f"{x:016x}"
    cases = spark.createDataFrame([], "id string, project_id string, phash string")
    for project, rows in {
        "pair": [("a", h(0)), ("b", h(3))], "chain": [("a", h(0)), ("b", h(0xF)), ("c", h(0x1F0F))], "split": [("a", h(0)), ("b", h(0xFFF))],
        "alone": [("a", h(0)), ("b", h(1)), ("c", "f" * 16)], "bad": [("a", h(0)), ("b", h(1)), ("c", None), ("d", "zzzz"), ("e", "g" * 16), ("f", "")], "copies": [("a", h(9)), ("b", h(9)), ("c", "F" * 16)], "edge": [("a", h(0)), ("b", "ff00000000000000")],
    }.items():
        cases = cases.unionByName(hashed(spark, *rows, project=project))
    found = {}
    for r in clusters(cases).collect():
        found.setdefault((r.project_id, r.root), set()).add(r.id)
    assert sorted((p, "".join(sorted(m))) for (p, _), m in found.items()) == [("alone", "ab"), ("bad", "ab"), ("chain", "abc"), ("copies", "ab"), ("edge", "ab"), ("pair", "ab")]
    groups, members = regrouped(cases)
    ids = {r.project_id: r.id for r in groups.collect()}
    assert ids == {r.project_id: r.id for r in regrouped(cases.repartition(5))[0].collect()} and all(len(i) == 64 for i in ids.values())
    assert ids["pair"] == ids["alone"] != ids["chain"] and members.count() == 13
    assert {r.params for r in groups.collect()} == {'{"threshold":8,"version":1}'}
    assert regrouped(cases.limit(0))[1].collect() == []


def test_near_hashes_once(spark):
    import random

    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(3)]
    hs = {h ^ sum(1 << b for b in r.sample(range(64), r.randrange(7))) for h in base for _ in range(60)}
    signed = [h - (1 << 64) if h >> 63 else h for h in hs]
    got = [tuple(x) for x in near_hashes(spark.createDataFrame([("p", h) for h in signed], "project_id string, h bigint")).collect()]
    want = {("p", a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 8}
    assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        near_hashes(spark.createDataFrame([], "project_id string, h bigint"), 18)


def test_connected_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(505, 501), (505, 501), (7, 7)], "a int, b int")
    got = {r.node: r.root for r in connected(edges, "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {501: 501, 505: 501}
    assert connected(edges.limit(0), "a", "b").collect() == []


def test_scalars(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    names = ["/a/b.jpg", "C:\\x\\y.HEIC", "plain", "/ends/", ".jpg", "/x/.png", "a.heif", "b.JPeG", "c.txt"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select(P.file_name(F.col("p")).alias("n"), P.is_supported(F.col("p")).alias("s"), P.is_heic(F.col("p")).alias("h")).collect()
    assert [r.n for r in rows] == ["b.jpg", "y.HEIC", "plain", "/ends/", ".jpg", ".png", "a.heif", "b.JPeG", "c.txt"]
    assert [r.s for r in rows] == [True, True, False, False, False, False, True, True, False]
    assert [r.h for r in rows] == [False, True, False, False, False, False, True, False, False]
    assert one(P.exposure_flag(F.lit(0.5), F.lit(0.5), F.lit(0.5)))[0] == "over" and one(P.exposure_flag(F.lit(0.19), F.lit(0.0), F.lit(0.0)))[0] == "under"
    assert one(P.quality_badges(F.lit(True), F.lit("over")), P.quality_badges(F.lit(None).cast("boolean"), F.lit("normal"))) == (["blur", "over"], [])
    assert one(P.renamed(F.lit("a.b.jpg"), F.lit(2)), P.renamed(F.lit("x"), F.lit(1)), P.renamed(F.lit(".jpg"), F.lit(1)), P.renamed(F.lit("a.jpg"), F.lit(0))) == ("a.b (2).jpg", "x (1)", ".jpg (1)", "a.jpg")
    assert one(P.fit_side(F.lit(800), F.lit(600), 400), P.fit_side(F.lit(600), F.lit(800), 400), P.fit_side(F.lit(5), F.lit(1000), 10)) == (400, 300, 1)
    assert one(P.percent(F.lit(1), F.lit(3)), P.percent(F.lit(5), F.lit(4)), P.percent(F.lit(1), F.lit(0))) == (33, 100, None)
    assert one(P.parse_phash(F.lit("f" * 16)), P.parse_phash(F.lit("+fffffffffffffff")), P.parse_phash(F.lit("zzzz"))) == (-1, None, None)
    assert one(P.shown_date(F.lit("2024-05-01T10:20:30+00:00"), "never"), P.shown_date(F.lit(None).cast("string"), "never"), P.shown_date(F.lit("odd"), "never")) == ("2024-05-01 10:20", "never", "odd")


def test_latest(spark):
    log = spark.createDataFrame([("a", 1, "x", None), ("a", 3, None, "p"), ("a", 2, "y", "q"), ("b", 1, "z", "r")], "k string, s int, v string, w string")
    assert {tuple(r) for r in latest(log, ["k"], ["s"], ["v", "w"]).collect()} == {("a", None, "p"), ("b", "z", "r")}


def test_stash(spark):
    stash = Stash(spark, "t")
    df = stash.put(spark.range(5))
    assert df.count() == 5 and df._stash_path.startswith(work_dir(spark))
    stash.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(df._stash_path)


def test_scratch(spark):
    with scratch(spark):
        inner = Stash(spark, "s").put(spark.range(3))
        with scratch(spark):
            gone = Stash(spark, "s").put(spark.range(3))
        with pytest.raises(Exception):
            spark.read.parquet(gone._stash_path)
        assert inner.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(inner._stash_path)


def test_near_hashes_small_driver(spark):
    """No number of copies of a row for its keys is hidden from Spark's size estimates, which would send them all through the driver."""
    classes = Stash(spark, "t").put(spark.range(3000).select(F.lit("p").alias("project_id"), F.xxhash64("id").alias("h")))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        pairs = near_hashes(classes)
        plan = pairs._jdf.queryExecution().executedPlan()
        sent = [line for line in plan.toString().splitlines() if "BroadcastExchange" in line]
        assert len(sent) <= 1 and "posexplode" not in plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_near_hashes_blocks(spark):
    import random

    r = random.Random(2)
    sizes = {"a": 150, "b": 41, "c": 1, "d": 2}
    made = {(p, h ^ sum(1 << b for b in r.sample(range(64), r.randrange(7)))) for p, n in sizes.items() for h in [r.getrandbits(64) for _ in range(3)] for _ in range(n)}
    rows = [(p, h - (1 << 64) if h >> 63 else h, k) for k, (p, h) in enumerate(sorted(made))]
    want = {(p, a, b, d, m, n) for p, a, m in rows for q, b, n in rows if p == q and a < b and (d := ((a ^ b) & (1 << 64) - 1).bit_count()) <= 8}
    df = spark.createDataFrame([*rows, (None, 1, -1), (None, 2, -2), ("a", None, -3)], "project_id string, h bigint, n bigint")
    for block in (7, 100, 50_000):
        got = [tuple(x) for x in near_hashes(df.repartition(3), block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("threshold", [0, 3, 8, 14])
def test_pigeonholes(monkeypatch, threshold):
    import numpy as np

    from lumasieve.functions import pigeonholes

    r = np.random.default_rng(threshold)
    flips = (np.uint64(1) << r.integers(0, 64, (300, 8), dtype=np.uint64)) * (r.random((300, 8)) < 0.6)
    x = np.unique(np.bitwise_xor.reduce(flips, axis=1) ^ r.integers(0, 1 << 63, 60, dtype=np.uint64).repeat(5))
    y = x[::2] ^ np.uint64(4)
    for few, chunk, dearer in ((10**9, 100, 4), (0, 100, 0), (0, 1 << 20, 0), (0, 100, 10**9)):  # one by one, by holes, given up
        for name, value in (("FEW", few), ("CHUNK", chunk), ("DEARER", dearer)):
            monkeypatch.setattr(pigeonholes, name, value)
        for other in (None, y):
            got = [(a, b) for i, j in pigeonholes.near(x, other, threshold) for a, b in zip(i.tolist(), j.tolist())]
            i, j = np.nonzero(np.bitwise_count(x[:, None] ^ (x if other is None else y)) <= threshold)
            assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in zip(i.tolist(), j.tolist()) if other is not None or a < b}
        assert not any(len(i) for i, _ in pigeonholes.near(x[:0], None, threshold))


def test_groups_small_driver(spark):
    """Files of numbers are far smaller than the rows in memory, so their size must not make Spark send a side of a join through the driver."""
    photos = hashed(spark, *[(f"{k}-{c}", f"{k:016x}") for k in (0, 1, 1 << 40) for c in "ab"])
    for df in (clusters(photos), regrouped(photos)[1], connected(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long"), "a", "b")):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.root, r.id) for r in clusters(photos).collect()) == [(0, f"{k}-{c}") for k in (0, 1, 1 << 40) for c in "ab"]
