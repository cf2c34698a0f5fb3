import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumasieve.llm.components import components, consolidate, photo_components
from lumasieve.llm.cutoffs import DyadicCountTree, _scored, kept_photos, project_cutoffs, score_code
from lumasieve.llm.near_pairs import near_duplicates
from lumasieve.llm.queries import DUPLICATES
from lumasieve.llm.survivors import group_skyline, group_survivors, layered_members, layers
from lumasieve.llm.top_n import top_members
from lumasieve.llm.vptree import Trunk, near_pairs
from lumasieve.operators.instants import photo_instants
from lumasieve.runtime import Stash

from .helpers import GROUPS, MEMBERS, PHOTOS, SETTINGS, empty, frames, roots, sha


@pytest.fixture(scope="module", params=[1, 2])
def small(spark, request):
    dfs, rows = frames(spark, request.param)
    instants = {(r.photo_id, r.field): r.utc_micros for r in photo_instants(dfs[0], dfs[1]).collect()}
    return dfs, rows, instants


def brute_pairs(photos, instants):
    points = {p[0]: (p[1], int(p[10], 16), instants[p[0], "shot_at"]) for p in photos if p[0] is not None and p[1] and p[10] and re.fullmatch("[0-9a-fA-F]{16}", p[10]) and (p[0], "shot_at") in instants}
    ids = sorted(points)
    out = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            (p, h, t), (q, g, u) = points[a], points[b]
            if p == q and (h ^ g).bit_count() <= 8 and abs(t - u) <= 600_000_000:
                out.add((a, b))
    return out


@pytest.mark.parametrize("shard_rows", [20_000, 12])
def test_near_duplicates(small, shard_rows):
    (photos, settings, *_), rows, instants = small
    got = [tuple(r) for r in near_duplicates(photos, settings, shard_rows=shard_rows).collect()]
    want = brute_pairs(rows[0], instants)
    assert len(want) > 20 and Counter(got) == Counter(want)


@pytest.mark.parametrize("shard_rows", [20_000, 2])
def test_rows_of_one_id_that_differ(spark, shard_rows):
    """Each counts with its own hash and time: no link is lost, none comes out twice, none is of an id with itself."""
    at = "2024-05-01T12:00:00Z"
    rows = [("A", "0" * 16, at), ("A", "f" * 16, at), ("A", "0" * 15 + "1", "2024-05-01T12:01:00Z"), ("A", "f" * 16, at), ("B", "0" * 16, at), ("C", "f" * 16, at)]
    photos = spark.createDataFrame([(i, "p", h, t) for i, h, t in rows], "id string, project_id string, phash string, shot_at string")
    got = sorted(map(tuple, near_duplicates(photos, empty(spark, SETTINGS), shard_rows=shard_rows).collect()))
    assert got == [("A", "B"), ("A", "C")]


@pytest.mark.parametrize("seed", range(6))
def test_near_pairs_kernel(seed):
    r = np.random.default_rng(seed)
    n = 600
    base = r.integers(0, 2**63, 4, dtype=np.uint64)
    h = base[r.integers(0, 4, n)] ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) * r.integers(0, 2, n).astype(np.uint64)
    if seed == 0:
        h[:] = 7
    shard, visits, t = np.sort(r.integers(0, 5, n)), r.random(n) < 0.3, r.integers(-1000, 1000, n)
    got = Counter(frozenset(x) for i, j in near_pairs(shard, visits, h, t, 8, 500) for x in zip(i.tolist(), j.tolist()))
    want = Counter(
        frozenset((a, b)) for a in range(n) for b in range(a + 1, n)
        if shard[a] == shard[b] and not (visits[a] and visits[b]) and (int(h[a]) ^ int(h[b])).bit_count() <= 8 and abs(int(t[a]) - int(t[b])) <= 500
    )
    assert got == want


def test_large_shards():
    """Even spread, bursts and copies of one fingerprint, beyond the size up to which nodes always split."""
    r = np.random.default_rng(1)
    n = 6000
    base = r.integers(0, 2**63, n // 20, dtype=np.uint64)
    t = r.integers(0, 3000, n)
    for h in (r.integers(0, 2**63, n, dtype=np.uint64), base[r.integers(0, n // 20, n)] ^ (np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)), np.full(n, 9, np.uint64), np.where(np.arange(n) % 2 == 0, r.integers(0, 2**63, n, dtype=np.uint64), base[np.arange(n) % 3] ^ (np.uint64(1) << r.integers(0, 9, n).astype(np.uint64)))):
        visits = np.arange(n) % 3 == 0
        got = sorted(x for i, j in near_pairs(np.zeros(n, np.int64), visits, h, t, 8, 20) for x in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
        want = []
        for a in range(n):
            b = np.flatnonzero((np.abs(t[a + 1 :] - t[a]) <= 20) & (np.bitwise_count(h[a + 1 :] ^ h[a]) <= 8) & ~(visits[a] & visits[a + 1 :])) + a + 1
            want += [(a, int(x)) for x in b]
        assert got == want


def test_large_shards_of_several_kinds():
    """Shards whose home rows pair and others whose don't, evenly spread and full of copies, side by side."""
    r = np.random.default_rng(2)
    n = 12_000
    shard, own = np.sort(r.integers(0, 2, n)), np.array([True, False])
    h = r.integers(0, 2**63, n, dtype=np.uint64)
    h[::3] = h[7] ^ (np.uint64(1) << r.integers(0, 64, len(h[::3])).astype(np.uint64))
    visits, t = r.random(n) < 0.4, r.integers(0, 2**62, 40)[r.integers(0, 40, n)]
    got = sorted(x for i, j in near_pairs(shard, visits, h, t, 8, 1000, own) for x in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist()))
    want = []
    for a in range(n):
        rest = slice(a + 1, n)
        meet = np.where(visits[a], ~visits[rest], visits[rest] | own[shard[a]])
        want += [(a, int(x)) for x in np.flatnonzero((shard[rest] == shard[a]) & meet & (np.abs(t[rest] - t[a]) <= 1000) & (np.bitwise_count(h[rest] ^ h[a]) <= 8)) + a + 1]
    assert got == want and len(want) > 1000


def test_many_shards_far_apart_in_time():
    """Shards times the range of their instants, 1970 to 9999, exceed 64 bits by far; rows of other shards have the same fingerprint."""
    r = np.random.default_rng(4)
    shards, each, last = 3000, 8, 253_402_300_799_000_000
    base = np.r_[0, last, r.integers(0, last, shards - 2)]
    shard = np.repeat(np.arange(shards), each)
    t = base[shard] + r.integers(-1000, 1000, len(shard))
    t[shard == 7] = np.resize([0, last], each)
    visits, h = r.random(len(shard)) < 0.3, np.full(len(shard), 9, np.uint64)
    got = Counter(frozenset(x) for i, j in near_pairs(shard, visits, h, t, 8, 500) for x in zip(i.tolist(), j.tolist()))
    want = Counter(
        frozenset((a, b)) for a in range(len(shard)) for b in range(a + 1, (a // each + 1) * each)
        if not (visits[a] and visits[b]) and abs(int(t[a]) - int(t[b])) <= 500
    )
    assert got == want


def test_trunk_keeps_every_pair():
    r = np.random.default_rng(5)
    base = np.array([0, 2**64 - 1, 0xFFFFFFFF, 0xFFFFFFFF00000000], np.uint64)  # far apart, so that radii can part them
    h = base[r.integers(0, 4, 800)] ^ (np.uint64(1) << r.integers(0, 64, 800).astype(np.uint64))
    trunk = Trunk(h[:300], 5, 8)
    row, leaf, guest = trunk.route(h, np.zeros(800, bool))
    assert len(set(leaf.tolist())) > 2
    at = defaultdict(lambda: ([], []))
    for x, y, g in zip(row.tolist(), leaf.tolist(), guest.tolist()):
        at[y][g].append(x)
    met = Counter(frozenset((a, b)) for home, guests in at.values() for k, a in enumerate(home) for b in home[k + 1 :] + guests)
    for a in range(800):
        for b in range(a + 1, 800):
            if (int(h[a]) ^ int(h[b])).bit_count() <= 8:
                assert met[frozenset((a, b))] == 1


def test_photo_components(small):
    (photos, settings, groups, members), rows, instants = small
    got = [tuple(r) for r in photo_components(photos, settings, groups, members, DUPLICATES).collect()]
    kept = {g[0] for g in rows[2] if g[2] in DUPLICATES and g[0] is not None}
    known = {p[0] for p in rows[0]}
    of = defaultdict(set)
    for g, p in rows[3]:
        if g in kept and p in known and p is not None:
            of[g].add(p)
    links = list(brute_pairs(rows[0], instants)) + [(min(m), x) for m in of.values() for x in m if x != min(m)]
    want = {(root, x) for x, root in roots(links).items()}
    assert Counter(got) == Counter(want)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "pairs"])
def test_consolidate(spark, shape):
    r = random.Random(shape)
    n = 400
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(n // 2)], "pairs": [(2 * i, 2 * i + 1) for i in range(n)]}[shape]
    r.shuffle(edges)
    rows = [(sha(a) if a % 3 else f"id-{a}", sha(b) if b % 3 else f"id-{b}") for a, b in edges]
    df = spark.createDataFrame(rows + rows[:20] + [(b, a) for a, b in rows[:20]] + [(None, "x"), ("y", None), ("z", "z")], "a string, b string")
    got = [tuple(x) for x in consolidate(df, "a", "b").collect()]
    assert Counter(got) == Counter((root, x) for x, root in roots([e for e in rows if e[0] != e[1]]).items())


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "u bigint, v bigint"), Stash(spark, "t")).collect() == []


def usable(s):
    return s is not None and not math.isnan(s) and s >= 0


def test_cutoffs(small):
    (photos, settings, *_), rows, _ = small
    share = {"p1": 333, "p2": 1000, "empty": 100}
    scores = defaultdict(dict)
    for p in rows[0]:
        if p[0] is not None and p[1] and p[11] == "done" and usable(p[6]):
            scores[p[1]][p[0]] = p[6]
    want, cuts = set(), set()
    for project, own in scores.items():
        if project in share:
            fit = [s for s in own.values() if sum(x >= s for x in own.values()) * 1000 >= len(own) * share[project]]
            kept = {(project, i) for i, s in own.items() if s >= max(fit)}
            want |= kept
            cuts.add((project, max(fit), len(kept), len(own)))
    assert len(cuts) == 2
    assert Counter(map(tuple, kept_photos(photos, settings).collect())) == Counter(want)
    assert {tuple(r) for r in project_cutoffs(photos, settings).collect()} == cuts


def test_tree_adds_batches(spark):
    r = random.Random(4)
    scores = [r.choice([r.random() * 500, 3.0, 0.0, 1e300]) for _ in range(500)]
    df = spark.createDataFrame([("a", s) for s in scores], "source string, score double").withColumn("code", score_code(__import__("pyspark").sql.functions.col("score")))
    tree = DyadicCountTree(spark, f"{Stash(spark, 'tree').root}")
    parts = df.randomSplit([0.5, 0.5], 1)
    for batch in ("x", "y", "x"):
        tree.add_batch(parts["xy".index(batch)], batch)
    for permille in (1, 250, 500, 999, 1000):
        leaf = tree.descend(spark.createDataFrame([("a", permille)], "source string, permille int")).collect()
        codes = sorted((x.code for x in df.collect()), reverse=True)
        rank = max(1, -(-500 * permille // 1000))
        assert [x.code for x in leaf] == [codes[rank - 1]] and leaf[0].above + leaf[0].rank == rank


@pytest.mark.parametrize("subgroups", [1, 64])
def test_top_members(small, subgroups):
    (photos, _, _, members), rows, _ = small
    best = {}
    for p in rows[0]:
        if p[0] is not None and usable(p[6]):
            best[p[0]] = max(best.get(p[0], 0.0), p[6])
    of = defaultdict(set)
    for g, p in rows[3]:
        if g is not None and p is not None:
            of[g].add(p)
    want = {(g, p) for g, m in of.items() for p in sorted(m, key=lambda x: (x not in best, -best.get(x, 0), x))[:3]}
    got = top_members(members, photos, 3, subgroups).collect()
    assert Counter((r.group_id, r.photo_id) for r in got) == Counter(want)
    assert all(1 <= r["rank"] <= 3 for r in got)


def test_survivors(small):
    (photos, settings, groups, members), rows, instants = small
    facts = {}
    for p in rows[0]:
        if p[0] is not None:
            flag = (p[9] or "").strip(" \t").lower()
            complete = usable(p[6]) + (p[8] is not None) + (flag in ("normal", "over", "under")) + bool(p[10] and re.fullmatch("[0-9a-fA-F]{16}", p[10])) + ((p[0], "shot_at") in instants)
            facts[p[0]] = (p[11] == "done", complete, flag == "normal", usable(p[6]), p[6] if usable(p[6]) else 0.0, instants.get((p[0], "created_at"), -(2**70)), flag in ("normal", "over", "under"))
    kept = {g[0] for g in rows[2] if g[2] in DUPLICATES and g[0] is not None}
    of = defaultdict(set)
    for g, p in rows[3]:
        if g in kept and p is not None:
            of[g].add(p)
    want = []
    for g, m in of.items():
        f = {i: facts.get(i, (False, 0, False, False, 0.0, -(2**70), False)) for i in m}
        first = min(m, key=lambda i: (-f[i][0], -f[i][1], -f[i][2], -f[i][3], -f[i][4], -f[i][5], i))
        blur = min((i for i in m if f[i][3]), key=lambda i: (-f[i][0], -f[i][4], i), default="")
        flag = min((i for i in m if f[i][6]), key=lambda i: (-f[i][5], i), default="")
        want.append((g, first, blur, flag))
    rows_ = group_survivors(members, groups, photos, settings, DUPLICATES).collect()
    assert Counter(tuple(r)[:4] for r in rows_) == Counter(want)
    assert all((r.blur_layer is None) == (r.blur_from == "") and (r.flag_layer is None) == (r.flag_from == "") for r in rows_)
    # The skyline of the whole group, against all pairs; trust is the triple of done, normal and score, no score lowest.
    sky = set()
    for g, m in of.items():
        f = {i: facts.get(i, (False, 0, False, False, 0.0, -(2**70), False)) for i in m}
        value = {i: ((v[0], v[2], v[4] if v[3] else -1.0), v[1], v[5]) for i, v in f.items()}
        sky |= {(g, i) for i, x in value.items() if not any(y != x and all(p >= q for p, q in zip(y, x)) for y in value.values())}
    got = group_skyline(members, groups, photos, settings, DUPLICATES).collect()
    assert Counter(map(tuple, got)) == Counter(sky)
    assert 0 < len(sky) < sum(map(len, of.values()))
    assert layered_members(members, groups, photos, settings, DUPLICATES).where("layer > 0").count() > 0


@pytest.mark.parametrize("seed", range(3))
def test_dominance_layers(spark, seed):
    """Layers of all members, against their definition: one more than the deepest of those that dominate."""
    r = random.Random(seed)
    rows = [(g, i, r.randrange(2), r.randrange(2), r.choice([None, 1.0, 2.0, r.random()]), r.randrange(6), r.choice([-(1 << 63), 5, r.randrange(40)]), True) for g in ("a", "b") for i in range(120)]
    rows += [("c", i, 1, 1, float(i), 5, i, True) for i in range(50)] + [("d", i, 1, 1, float(i), 5, -i, True) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, k int, done int, normal int, score double, complete int, recent bigint, has_flag boolean")
    got = {(x.g, x.k): x.layer for x in layers(df.repartition(5)).collect()}
    value = {(x[0], x[1]): ((x[2], x[3], -1.0 if x[4] is None else x[4]), x[5], x[6]) for x in rows}
    want = {}
    for at in sorted(value, key=value.get, reverse=True):
        want[at] = max((want[o] + 1 for o in want if o[0] == at[0] and value[o] != value[at] and all(p >= q for p, q in zip(value[o], value[at]))), default=0)
    assert got == want
    assert max(v for k, v in got.items() if k[0] == "c") == 49 and max(v for k, v in got.items() if k[0] == "d") == 0


def test_empty_tables(spark):
    photos, settings, groups, members = (empty(spark, s) for s in (PHOTOS, SETTINGS, GROUPS, MEMBERS))
    assert near_duplicates(photos, settings).collect() == []
    assert photo_components(photos, settings, groups, members, DUPLICATES).collect() == []
    assert kept_photos(photos, settings).collect() == []
    assert top_members(members, photos).collect() == []
    assert group_survivors(members, groups, photos, settings, DUPLICATES).collect() == []
    assert _scored(photos, Stash(spark, "t")).collect() == []
