import json
import os
import struct
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumasieve.errors import EngineError, Invalid, NotFound
from lumasieve.functions.pixels import blur, exposure, grey, normalised, phash
from lumasieve.operators import analysis
from lumasieve.operators.analysis import analyse, analyse_folder, features
from lumasieve.operators.export import export_plan, export_summary
from lumasieve.operators.transcode import fitted, transcode, transcode_file
from lumasieve.schema import GROUP_MEMBERS, PHOTOS, checked, valid_rows
from lumasieve.sources.exif import iso_time, shot_at
from lumasieve.sources.images import Image, decode, decode_png, encode_png
from lumasieve.sources.json_lines import read_outcomes
from lumasieve.sources.media_files import media_files, scan_summary
from lumasieve.store import Store
from lumasieve.streaming.ingest import apply_statuses, clicks, found_files, ingest, status_counts
from lumasieve.workspace import Workspace


def checkerboard(n=256, cell=8, colour=True):
    y, x = np.mgrid[:n, :n]
    g = (((x // cell) + (y // cell)) % 2 * 255).astype(np.uint8)
    return np.stack([g] * 3, 2) if colour else g


def put(path, pixels):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(encode_png(pixels))


def exif_jpeg(taken=b"2026:05:24 10:30:00\0", changed=None):
    """The head of a JPEG with an EXIF block."""
    entries = [(0x8769, 4, 1, None)] + ([(0x0132, 2, len(changed), changed)] if changed else [])
    ifd0 = 8
    after = ifd0 + 2 + 12 * len(entries) + 4
    tail = b""
    out = len(entries).to_bytes(2, "little")
    sub_at = after + (len(changed) if changed else 0)
    for tag, kind, n, value in entries:
        at = sub_at if value is None else after
        out += tag.to_bytes(2, "little") + kind.to_bytes(2, "little") + n.to_bytes(4, "little") + at.to_bytes(4, "little")
        tail += value or b""
    out += bytes(4) + tail
    sub = b"\x01\0" + (0x9003).to_bytes(2, "little") + b"\x02\0" + len(taken).to_bytes(4, "little") + (sub_at + 18).to_bytes(4, "little") + bytes(4) + taken if taken else b"\0\0" + bytes(4)
    block = b"Exif\0\0II*\0\x08\0\0\0" + out + sub
    return b"\xff\xd8\xff\xe1" + (len(block) + 2).to_bytes(2, "big") + block + b"\xff\xd9"


def test_exif():
    assert shot_at(exif_jpeg()) == "2026-05-24T10:30:00"
    assert shot_at(exif_jpeg(taken=None, changed=b"2020:01:02 03:04:05\0")) == "2020-01-02T03:04:05"
    assert shot_at(exif_jpeg(taken=b"0000:00:00 00:00:00\0", changed=b"2020:01:02 03:04:05\0")) is None
    assert shot_at(b"") is None and shot_at(b"\xff\xd8\xff\xe1\0\x10Exif\0\0II*\0") is None
    assert iso_time("2026:5:4 1:2:3") == "2026-05-04T01:02:03" and iso_time(b" 2026:05:04 01:02:03\0 ") == "2026-05-04T01:02:03" and iso_time(None) is None


def test_png_round_trip():
    r = np.random.default_rng(1)
    for shape in ((7, 5, 3), (1, 1, 3), (16, 9)):
        pixels = r.integers(0, 256, shape).astype(np.uint8)
        back = decode_png(encode_png(pixels))
        assert (back.squeeze() == pixels.squeeze()).all()


def test_pixels():
    board = grey(checkerboard())
    soft = normalised(board, 64)
    assert blur(board)[0] > blur(np.repeat(np.repeat(soft, 4, 0), 4, 1) // 2)[0] and not blur(board)[1]
    assert blur(np.zeros((2, 9), np.uint8)) == (0.0, True)
    assert exposure(np.full((9, 9), 255, np.uint8))[1] == "over" and exposure(np.zeros((9, 9), np.uint8))[1] == "under" and exposure(np.full((9, 9), 128, np.uint8))[1] == "normal"
    half = np.zeros((10, 10), np.uint8)
    half[:5] = 255
    assert exposure(half)[1] == "over" and exposure(np.zeros((0, 0), np.uint8)) == (0.0, "normal")
    gradient = np.tile(np.arange(256, dtype=np.uint8), (256, 1))
    assert phash(gradient) != phash(board) and len(phash(board)) == 16 and phash(board) == phash(board.copy())
    r = np.random.default_rng(0)
    scene = np.repeat(np.repeat(r.integers(20, 230, (9, 9)), 28, 0), 28, 1).astype(np.uint8)
    noise = (scene + r.integers(-3, 4, scene.shape)).astype(np.uint8)
    assert (int(phash(scene), 16) ^ int(phash(noise), 16)).bit_count() <= 8
    assert normalised(np.zeros((2048, 512), np.uint8)).shape == (1024, 256) and normalised(np.zeros((5, 5), np.uint8)).shape == (5, 5)
    assert fitted(800, 600, 400) == (400, 300) and fitted(300, 900, 450) == (150, 450) and fitted(100, 100, 400) == (100, 100) and fitted(10, 10, 0) == (1, 1)


def test_media_files(spark, tmp_path):
    for name in ("_DSC1.jpg", ".d.png", "a.JPG", "_x/b.heic", "note.txt", "sub/deep/c.jpeg"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
    (tmp_path / "link.jpg").symlink_to(tmp_path / "a.JPG")
    files = media_files(spark, str(tmp_path))
    assert {os.path.relpath(r.path, tmp_path) for r in files.collect()} == {"_DSC1.jpg", ".d.png", "a.JPG", "_x/b.heic", "note.txt", "sub/deep/c.jpeg"}
    assert tuple(scan_summary(files).first()) == (6, 0)
    deep = tmp_path / "down"
    for i in range(300):
        (deep / str(i)).mkdir(parents=True)
        (deep / str(i) / "x.jpg").write_bytes(b"x")
    wide = media_files(spark, str(deep))
    assert wide.count() == 300 and wide.select("path").distinct().count() == 300 and wide.rdd.getNumPartitions() > 256
    assert tuple(scan_summary(media_files(spark, str(tmp_path / "none"))).first()) == (0, 1)


def test_analyse(spark, tmp_path):
    put(f"{tmp_path}/a.png", checkerboard())
    (tmp_path / "b.png").write_bytes(b"no image")
    files = spark.createDataFrame([("a", f"{tmp_path}/a.png"), ("b", f"{tmp_path}/b.png"), ("c", f"{tmp_path}/none.png")], "id string, path string")
    rows = {r.id: r for r in analyse(files).collect()}
    assert rows["a"].ok and rows["a"].blur_score > 100 and rows["a"].is_blurry is False and rows["a"].shot_at is None and len(rows["a"].phash) == 16
    assert not rows["b"].ok and rows["b"].phash is None and "Error" in rows["b"].error and rows["c"].error.startswith("FileNotFoundError")
    assert features(encode_png(checkerboard()), blur_threshold=1e9)["is_blurry"] is True
    content = spark.createDataFrame([("x", bytearray(encode_png(checkerboard())))], "id string, content binary")
    assert analyse(content).first().phash == rows["a"].phash


def test_capture_time_after_the_image_data(tmp_path):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    exif = b"II*\0" + struct.pack("<IHHHIII", 8, 1, 0x0132, 2, 20, 26, 0) + b"2026:05:24 10:30:00\0"
    (tmp_path / "late one.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", bytes(300_000)) + chunk(b"eXIf", exif))
    segment = b"\xff\xe2" + struct.pack(">H", 60_002) + bytes(60_000)
    (tmp_path / "late.jpg").write_bytes(b"\xff\xd8" + segment * 5 + b"\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif)
    (tmp_path / "empty.png").write_bytes(b"")
    assert analysis._time_of(f"file://{tmp_path}/late%20one.png") == analysis._time_of(f"{tmp_path}/late.jpg") == "2026-05-24T10:30:00"
    assert analysis._time_of(f"{tmp_path}/empty.png") is None and analysis._time_of(f"{tmp_path}/none.png") is None


def test_analyse_folder(spark, tmp_path):
    jvm = spark._jvm
    picture = jvm.java.awt.image.BufferedImage(64, 48, 1)
    for x in range(0, 64, 2):
        for y in range(48):
            picture.setRGB(x, y, 0xFF8000)
    os.makedirs(f"{tmp_path}/f/g")
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(f"{tmp_path}/f/g/a b.jpg"))
    jvm.javax.imageio.ImageIO.write(picture, "png", jvm.java.io.File(f"{tmp_path}/f/a.png"))
    with open(f"{tmp_path}/f/bad.jpg", "wb") as f:
        f.write(b"x")
    rows = {os.path.basename(r.id): r for r in analyse_folder(spark, f"{tmp_path}/f").collect()}
    png = features(open(f"{tmp_path}/f/a.png", "rb").read())
    assert rows["a.png"].ok and abs(rows["a.png"].exposure_score - png["exposure_score"]) < 1e-9 and rows["a.png"].phash == png["phash"]
    assert not rows["bad.jpg"].ok and len(rows) == 3
    jpg = next(r for n, r in rows.items() if n.endswith("b.jpg"))
    assert jpg.ok and abs(jpg.exposure_score - png["exposure_score"]) < 0.05


def test_json_lines(spark, tmp_path):
    put(f"{tmp_path}/a.png", checkerboard(64))
    requests = ['{"id": 1, "op": "echo", "payload": {"text": "hi"}}', '{"id": 2, "op": "nope"}', "not json", f'{{"id": 4, "op": "analyze", "payload": {{"path": "{tmp_path}/none"}}}}', f'{{"id": "5", "op": "analyze", "payload": {{"path": "{tmp_path}/a.png", "blurVarThreshold": 1e9}}}}',
                f'{{"id": 6, "op": "transcode", "payload": {{"path": "{tmp_path}/a.png", "dest": "{tmp_path}/b.png", "maxSide": 8}}}}']
    run = subprocess.run([sys.executable, "-m", "lumasieve.sources.json_lines"], input="\n".join([*requests, "", requests[0]]), capture_output=True, text=True, check=True)
    got = [json.loads(x) for x in run.stdout.splitlines()]
    assert got[0] == got[6] == {"id": 1, "result": "hi"} and "unknown op" in got[1]["error"] and got[2]["id"] is None and got[3]["error"].startswith("FileNotFoundError")
    assert got[4]["result"]["isBlurry"] is True and got[5]["result"] == {"dest": f"{tmp_path}/b.png", "width": 8, "height": 8}
    lines = spark.createDataFrame([(x,) for x in [*run.stdout.splitlines(), "odd"]], "value string")
    rows = {r.id: r for r in read_outcomes(lines).collect()}
    assert rows["5"].ok and rows["5"].phash == got[4]["result"]["phash"] and not rows["4"].ok and rows["4"].error.startswith("FileNotFoundError") and rows[None].error


def test_transcode(spark, tmp_path):
    put(f"{tmp_path}/a.png", checkerboard(64))
    assert transcode_file(f"{tmp_path}/a.png", f"{tmp_path}/out/x.png", 16) == (16, 16)
    with open(f"{tmp_path}/out/x.png", "rb") as f:
        assert decode(f.read()).shape[:2] == (16, 16)
    files = spark.createDataFrame([("a", f"{tmp_path}/a.png", 5), ("b", f"{tmp_path}/none.png", 5)], "id string, path string, mtime_ns bigint")
    for again in (False, True):
        rows = {r.id: r for r in transcode(files, f"{tmp_path}/cache", 32, "png").collect()}
        assert (rows["a"].width is None) == again and os.path.exists(rows["a"].dest) and rows["b"].error
    assert not [n for n in os.listdir(f"{tmp_path}/cache") if n.endswith(".part")]
    if Image is None:
        assert "encoder" in {r.id: r for r in transcode(files, f"{tmp_path}/cache").collect()}["a"].error


def test_workspace(spark, tmp_path):
    ticks = []
    w = Workspace(spark, f"{tmp_path}/w", lambda *a: ticks.append(a), batch=2)
    assert w.echo("hi") == "hi"
    for call in (lambda: w.scan_folder("/"), w.group_photos, w.list_groups, lambda: w.export_keep("/tmp"), w.analyze_pending):
        with pytest.raises(Invalid):
            call()
    with pytest.raises(Invalid):
        w.create_project("  ")
    with pytest.raises(NotFound):
        w.open_project("none")
    first, second = w.create_project(" One "), w.create_project("Two")
    assert w.current is None
    w.open_project(first)
    with pytest.raises(NotFound):
        w.scan_folder(f"{tmp_path}/nowhere")
    pics = f"{tmp_path}/pics"
    put(f"{pics}/a.png", checkerboard(64))
    put(f"{pics}/sub/a.png", checkerboard(64))
    put(f"{pics}/g.png", np.tile(np.arange(64, dtype=np.uint8) * 4, (64, 1)))
    os.makedirs(pics, exist_ok=True)
    with open(f"{pics}/bad.jpg", "wb") as f:
        f.write(b"x")
    scan = w.scan_folder(pics)
    assert scan.found == 4 and scan.skipped == 0
    ids = {r.path: r.id for r in scan.photos.collect()}
    w.set_status(ids[f"{pics}/a.png"], "reject")
    w.set_status(ids[f"{pics}/a.png"], "keep")
    w.set_status(ids[f"{pics}/sub/a.png"], "keep")
    for bad in (("none", "keep"), (ids[f"{pics}/a.png"], "maybe")):
        with pytest.raises(EngineError):
            w.set_status(*bad)
    again = {r.path: r.status for r in w.scan_folder(pics).photos.collect()}
    assert again[f"{pics}/a.png"] == "keep" and len(again) == 4
    done = w.analyze_pending()
    assert (done.analyzed, done.failed, done.cancelled) == (3, 1, False)
    assert w.analyze_pending().analyzed == 0
    states = {r.path: r for r in w.store.photos(first).collect()}
    assert states[f"{pics}/bad.jpg"].analysis_state == "failed" and states[f"{pics}/a.png"].phash
    for _ in range(2):
        made = w.group_photos()
        assert (made.groups, made.grouped_photos) == (1, 2)
    ids_once = [r.id for r in w.store.groups(first, "phash_burst")[0].collect()]
    w.group_photos()
    assert [r.id for r in w.store.groups(first, "phash_burst")[0].collect()] == ids_once
    grouped, ungrouped = w.list_groups()
    assert grouped.count() == 2 and ungrouped.count() == 2
    out = f"{tmp_path}/out"
    os.makedirs(out)
    exported = w.export_keep(out)
    assert (exported.exported, exported.renamed, exported.skipped, exported.failed) == (2, 1, 0, [])
    assert sorted(os.listdir(out)) == ["a (1).png", "a.png"]
    assert w.transcode_for_display(ids[f"{pics}/a.png"], 32, "png") == w.transcode_for_display(ids[f"{pics}/a.png"], 32, "png")
    with pytest.raises(EngineError):
        w.transcode_for_display("none")
    names = [(r.name, r.photo_count) for r in w.list_projects().orderBy("pos").collect()]
    assert names == [("One", 4), ("Two", 0)]
    w.open_project(second)
    assert w.scan_folder(pics).found == 4
    w.delete_project(first)
    assert [(r.name, r.photo_count) for r in w.list_projects().collect()] == [("Two", 4)] and w.current == second
    w.delete_project(second)
    assert w.current is None and sorted(os.listdir(out)) == ["a (1).png", "a.png"]
    assert {t[0] for t in ticks} == {"import", "analyze", "group"} and "done" in {t[3] for t in ticks}


def test_cancel_and_single_flight(spark, tmp_path):
    w = Workspace(spark, f"{tmp_path}/w", batch=1)
    w.open_project(w.create_project("x"))
    for i in range(3):
        put(f"{tmp_path}/p/{i}.png", checkerboard(32, 4 + i))
    w.scan_folder(f"{tmp_path}/p")
    w.progress = lambda phase, done, total, status: w.cancel_analysis()
    assert w.analyze_pending().cancelled
    assert w.store.photos().where("analysis_state = 'pending'").count() == 2
    w._analysing.acquire()
    assert w.analyze_pending().analyzed == 0
    w._analysing.release()
    w._grouping.acquire()
    assert w.group_photos().groups == 0


def test_store_version(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.add("projects", ("p", "n", "t"))
    assert Store(spark, f"{tmp_path}/s").read("projects").count() == 1 and store.version() == 4
    store._swap("schema.json", {"version": 99})
    with pytest.raises(EngineError):
        Store(spark, f"{tmp_path}/s")


def test_failure_keeps_earlier_values(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.add("photos", ("i", "p", "/a.jpg", "t"))
    store.add("outcomes", ("i", True, "2020", 5.0, False, 0.5, "normal", "ff", None, 1, "p"))
    store.add("outcomes", ("i", False, None, None, None, None, None, None, "E: x", 2, "p"))
    row = store.photos().first()
    assert (row.analysis_state, row.analysis_error, row.phash, row.blur_score) == ("failed", "E: x", "ff", 5.0)
    store.add("outcomes", ("i", True, None, 6.0, False, 0.5, "normal", "ee", None, 3, "p"))
    row = store.photos().first()
    assert (row.analysis_state, row.analysis_error, row.phash, row.shot_at) == ("done", None, "ee", None)
    store.add("outcomes", ("i", False, None, None, None, None, None, None, "E: y", 4, "p"))
    store.add("statuses", ("i", 1, "reject", "p"))
    store.add("statuses", ("i", 2, "keep", "p"))
    store.add("photos", ("j", "q", "/b.jpg", "t"))
    before = {r.id: r for r in store.photos().collect()}
    for _ in range(2):
        store.compact("p")
        assert {r.id: r for r in store.photos().collect()} == before and before["i"].status == "keep" and before["i"].phash == "ee"
    assert [len([n for n in os.listdir(f"{tmp_path}/s/{x}/project_id=p") if n.endswith(".parquet")]) for x in ("photos", "statuses", "outcomes")] == [1, 1, 2] or store.read("outcomes").count() == 2
    assert "PartitionFilters: [isnotnull(project_id" in store.photos("p")._jdf.queryExecution().executedPlan().toString()
    assert store.project_of("j") == "q" and store.project_of("none") is None


def test_streams(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    landing, taps = f"{tmp_path}/landing", f"{tmp_path}/taps"
    spark.createDataFrame([("p", "/x/a.jpg"), ("p", "/x/a.txt"), ("p", "/x/a.jpg")], "project_id string, path string").write.json(landing)
    for _ in range(2):
        ingest(found_files(spark, landing), store, f"{tmp_path}/c1").awaitTermination()
    assert store.photos().count() == 1
    spark.createDataFrame([("p", "/x/b.png"), ("p", "/x/a.jpg")], "project_id string, path string").write.mode("append").json(landing)
    ingest(found_files(spark, landing), store, f"{tmp_path}/c1").awaitTermination()
    assert store.photos().count() == 2
    photo = store.photos().where("path = '/x/a.jpg'").first().id
    spark.createDataFrame([(photo, "2024-01-01T00:00:00", "keep"), (photo, "2024-01-01T00:01:00", "reject"), (photo, "2024-01-01T00:02:00", "bad")], "id string, at string, status string").coalesce(1).write.json(taps)
    apply_statuses(clicks(spark, taps), store, f"{tmp_path}/c2").awaitTermination()
    assert {r.path: r.status for r in store.photos().collect()} == {"/x/a.jpg": "reject", "/x/b.png": "pending"}
    q = status_counts(clicks(spark, taps)).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM counted").first()[0] == 3


def test_export_plan_cases(spark):
    keeps = [("/out", "1", "/a/x.jpg"), ("/out", "2", "/b/x.jpg"), ("/out", "3", "/c/x (1).jpg"), ("/out", "4", "/out/y.jpg"), ("/out", "5", "/q/"), ("/out", "6", None), ("/out", "7", "/a/noext"), ("/out", "8", "/b/noext"), ("/out", "9", "/a/z.jpg"), ("/out", "2", "/b/x.jpg")]
    plan = export_plan(spark.createDataFrame(keeps, "dest string, id string, path string"), spark.createDataFrame([("/out", "z.jpg"), ("/out", "y.jpg")], "dest string, name string"))
    got = {r.id: (r.target, r.outcome) for r in plan.collect()}
    assert got == {
        "1": ("x.jpg", "exported"), "2": ("x (2).jpg", "renamed"), "3": ("x (1).jpg", "exported"), "4": (None, "skipped"), "5": (None, "failed"), "6": (None, "failed"), "7": ("noext", "exported"), "8": ("noext (1)", "renamed"), "9": ("z (1).jpg", "renamed"),
    }
    assert tuple(export_summary(plan).first()) == ("/out", 6, 3, 1, 2)
    many = [("/o", f"{i:06d}", f"/d{i}/n.jpg") for i in range(10_003)]
    out = export_plan(spark.createDataFrame(many, "dest string, id string, path string"), spark.createDataFrame([], "dest string, name string"))
    assert {r.outcome: r["n"] for r in out.groupBy("outcome").agg(F.count("*").alias("n")).collect()} == {"exported": 1, "renamed": 9999, "failed": 3}
    assert out.where("target is not null").select("target").distinct().count() == 10_000


def test_export_plan_one_by_one(spark):
    """Against a plan made file by file: first the smallest id of each name, then the others."""
    import random

    r = random.Random(2)
    names = ["a.jpg", "a (1).jpg", "a (2).jpg", "a (1) (1).jpg", "a", "a (1)", ".a", ".a (1)", "a.b (1)", "a (1).b (1)", "a (01).jpg", "a (0).jpg", "x.", "x (1).", "é (3).png", "é.png"]
    keeps = [(r.choice("pq"), f"{i:03}", f"/in/{r.choice(names)}") for i in range(200)] + [(None, "n", "/in/a"), ("p", None, "/in/a")]
    there = [("p", n) for n in names[::3]] + [("q", "a (3).jpg"), ("q", None)]
    plan = export_plan(spark.createDataFrame(keeps, "dest string, id string, path string"), spark.createDataFrame(there, "dest string, name string"))
    want, used = {}, {(d, n) for d, n in there}
    rows = sorted((d, i, p[4:]) for d, i, p in keeps if d and i)
    firsts = {(d, n): i for d, i, n in reversed(rows)}
    for d, i, n in sorted(rows, key=lambda x: firsts[x[0], x[2]] != x[1]):
        stem, ext = os.path.splitext(n)
        if n == "x." or n == "x (1).":
            stem, ext = n[:-1], "."
        target = next(t for k in range(9999) if (d, t := n if k == 0 else f"{stem} ({k}){ext}") not in used)
        used.add((d, target))
        want[i] = target
    assert {x.id: x.target for x in plan.collect()} == want


def test_schema_checks(spark):
    df = spark.createDataFrame([("g", "p", 1)], "group_id string, photo_id string, more int")
    assert checked(df, GROUP_MEMBERS).columns == ["group_id", "photo_id"]
    for bad in (df.drop("photo_id"), df.withColumn("photo_id", F.lit(1))):
        with pytest.raises(Invalid) as e:
            checked(bad, GROUP_MEMBERS)
        assert e.value.as_dict()["kind"] == "Validation"
    good = spark.createDataFrame([("i", "p", "/a", "keep", "t", None, None, None, None, "over", None, "done", None)], PHOTOS)
    assert valid_rows(good).count() == 1
    with pytest.raises(Exception, match="unknown"):
        valid_rows(good.withColumn("status", F.lit("nope"))).collect()
