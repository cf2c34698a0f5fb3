import random
from collections import Counter, defaultdict

import pytest

from lumasieve.llm.byte_bpe import ByteBpe
from lumasieve.llm.encoding import VOCABULARY, count_tokens, decode_ids, encode_texts
from lumasieve.llm.packing import fill_report, pack, plan
from lumasieve.llm.quality import CUTOFF, chi2_quantile, text_quality, text_shapes
from lumasieve.llm.text_shape import STATISTICS, _is_name, _named, measure, repeated

from .helpers import with_clashes

tokenizers = pytest.importorskip("tokenizers")
DOCS = "doc_id bigint, text string, lang string"


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def texts():
    r = random.Random(2)
    marks = lambda: r.choice([chr(r.randrange(1, 128)), chr(r.randrange(0x80, 0x2FF)), chr(r.randrange(0x4E00, 0x4F00)), chr(r.randrange(0x1F600, 0x1F640)), " ", "\n", "\t", "\x85", "\xa0", "'s"])
    out = ["".join(marks() for _ in range(r.randrange(80))) for _ in range(200)]
    return out + ["", " ", "<|endoftext|>", "x" * 30_000, "ab" * 20_000, " " * 10_000, "\n" * 500, "它" * 5000, "don't I'LL we've", "é​﻿"]


def test_merges_equal_the_library(library):
    with open(VOCABULARY, "rb") as f:
        bpe = ByteBpe(f.read())
    for t in texts():
        ids = bpe.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert bpe.decode(ids) == t


def test_encode_and_restore(spark, library):
    rows = [(i, t, None) for i, t in enumerate(texts())] + [(1000, None, "en"), (None, "no id", None), (0, texts()[0], None)]
    docs = with_clashes(spark.createDataFrame(rows, DOCS))
    encoded = encode_texts(docs, "doc_id", "text")
    got = Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect())
    assert got == Counter((i, tuple(library.encode(t, add_special_tokens=False).ids) if t else ()) for i, t, _ in rows)
    assert Counter(map(tuple, decode_ids(encoded, "doc_id", "ids").collect())) == Counter((i, t or "") for i, t, _ in rows)
    assert Counter(map(tuple, count_tokens(docs, "doc_id", "text").collect())) == Counter((i, len(ids)) for (i, ids), n in got.items() for _ in range(n))
    assert encode_texts(spark.createDataFrame([], DOCS), "doc_id", "text").collect() == []


def best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((capacity if fit is None else fit) - s)
    return len(gaps)


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 30, 100])
    sizes = [r.choice([r.randint(1, capacity), max(1, capacity // 3), max(1, capacity // 2)]) for _ in range(r.randrange(150))]
    rows, made = plan(Counter(sizes), capacity)
    fill, seen = defaultdict(int), Counter()
    for s, first, container, n in rows:
        for i in range(n):
            fill[container + i] += s
            seen[s, first + i] += 1
    assert max(fill.values(), default=0) <= capacity and len(fill) == made
    assert seen == Counter((s, i) for s, n in Counter(sizes).items() for i in range(n))
    assert made <= best_fit(sizes, capacity)


@pytest.mark.parametrize("ranked", [1_000_000, 7])
def test_pack(spark, ranked):
    r = random.Random(9)
    lengths = {i: r.choice([0, 1, 3, 10, 33, 50, 51, 100, 101, 250, 1000]) for i in range(300)}
    rows = [*lengths.items(), *list(lengths.items())[:50], (None, 5), (900, None)]
    sizes = with_clashes(spark.createDataFrame(rows, "doc_id bigint, tokens bigint"))
    packs = spark.createDataFrame([("a", 100), ("b", 7), ("b", 9), (None, 5), ("c", None), ("d", 0)], "pack_name string, capacity_tokens int")
    got = pack(sizes, packs, ranked).collect()
    for name, capacity in (("a", 100), ("b", 7)):
        fill, parts = defaultdict(int), defaultdict(list)
        for x in got:
            if x.pack_name == name:
                fill[x.container] += x.tokens
                parts[x.doc_id].append((x.piece, x.tokens))
        assert max(fill.values()) <= capacity
        for i, n in lengths.items():
            own = sorted(parts.pop(i, []))
            assert sum(t for _, t in own) == n and [p for p, _ in own] == list(range(len(own)))
            assert len(own) == -(-n // capacity) and all(t == capacity for _, t in own[:-1])
        assert not parts
    assert {x.pack_name for x in got} == {"a", "b"}
    report = {x.pack_name: x for x in fill_report(pack(sizes, packs), packs).collect()}
    assert all(x.containers >= x.least and x.unused >= 0 for x in report.values())
    assert pack(spark.createDataFrame([], "doc_id bigint, tokens bigint"), packs).collect() == []
    assert pack(sizes, packs.limit(0)).collect() == []


PROSE = [
    "The light was gone before we had the last picture, and nobody wanted to stay.", "After the export the names had changed, because there were two of the same kind.", "If the score is low, look at the whole picture before you decide what to keep.",
    "They said that it would rain, but the sun came out when we were on the roof.", "It is hard to say which of the two is the better one, so we kept both of them.", "My own choice would be the one with the red coat, because the eyes are open there.",
]
ITEMS = [random.Random(i).choice(["red coat", "roof", "two lenses", "harbour", "the old quay", "grey card", f"DSC_{i}.jpg", "market"]) for i in range(40)]
ODD = {
    "list": ["\n".join(f"- {w}" for w in ITEMS), "\n".join(reversed(ITEMS)), " / ".join(f"IMG_{i}.HEIC" for i in range(40))],
    "table": ["| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {i * 7} |" for i in range(20)), "\n".join(f"{i}\t{i * 3}\tok" for i in range(30)), "\n".join(f"lens {i}: {i * 9}" for i in range(20)), "\n".join(f"{i},ok,{i * 2}" for i in range(30))],
    "junk": ["the harbour " * 60, "qX7+aB" * 80, " ".join("".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=6)) for i in range(40)), "00000000  " + "\n00000010  ".join(["de ad be ef 00 11 22 33"] * 12), "�▒░¤ ¦¬□ " * 30, "<td class='x'>&nbsp;</td>" * 20],
}


def test_quality(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice(PROSE) for _ in range(r.randint(3, 12))), r.choice(["en", "EN", "en-EN", None])) for i in range(150)]
    docs += [(200, None, "en"), (201, "", None), (202, " \n\t", "en"), (203, docs[0][1], "en"), (203, docs[0][1], "en"), (204, "word", None), (205, (PROSE[0] + " " + PROSE[1] + "\n") * 1 + " ".join(PROSE * 400), "xx")]
    odd = {300 + k: (shape, t) for k, (shape, t) in enumerate((s, t) for s, v in ODD.items() for t in v)}
    docs += [(i, t, "en") for i, (_, t) in odd.items()]
    words = spark.createDataFrame([("en", w) for w in "the of and to a in is it that was for on with as be at we not are but what all were when which if".split()] + [(None, "x"), ("en", None)], "lang string, word string")
    df = with_clashes(spark.createDataFrame(docs, DOCS))
    rows = text_quality(df, words).collect()
    assert Counter(x.doc_id for x in rows) == Counter(i for i, *_ in docs)
    for x in rows:
        if x.doc_id in (200, 201, 202):
            assert x.n_words == 0 and x.shape is None and x.distance is None
        else:
            assert abs(sum(x[f"from_{k}"] for k in STATISTICS) - x.distance) < 1e-6 * max(1, x.distance)
            assert x["shape"] == "prose" or x.distance > CUTOFF
    shape = {x.doc_id: x["shape"] for x in rows}
    assert {i: shape[i] for i in odd} == {i: s for i, (s, _) in odd.items()}
    assert all(shape[i] == "prose" for i in [*range(150), 203, 204])
    found = Counter(map(tuple, text_shapes(df, words).collect()))
    assert found == Counter((x.doc_id, x["shape"]) for x in rows if x["shape"] in ("list", "table", "junk"))


GERMAN = [
    "Das Licht war weg, bevor wir das letzte Bild hatten, und niemand wollte bleiben.", "Nach dem Export hatten sich die Namen geändert, denn es gab zwei von der gleichen Art.", "Wenn der Wert niedrig ist, sieh dir das ganze Bild an, bevor du etwas behältst.",
    "Sie sagten, dass es regnen würde, aber die Sonne kam, als wir auf dem Dach waren.", "Es ist schwer zu sagen, welches der beiden das bessere ist, also blieben sie uns.", "Meine eigene Wahl wäre das mit dem roten Mantel, weil die Augen dort offen sind.",
]


def common(spark):
    rows = [("en", w) for w in "the of and to a in is it that was for on with as be at we not are but what all were when which if".split()]
    rows += [("de", w) for w in "der die das und war wir nicht ist es zu dem den in auf mit dass aber als wenn von sie sich du weil also".split()]
    return spark.createDataFrame(rows, "lang string, word string")


def many_prose(seed):
    r = random.Random(seed)
    docs = [(i, " ".join(r.sample(PROSE, r.randint(3, 6))), "en") for i in range(150)]
    return docs + [(200 + i, " ".join(r.sample(GERMAN, r.randint(3, 6))), "de") for i in range(20)]


@pytest.mark.parametrize("kind", ["list", "table"])
def test_copies_are_no_language(spark, kind):
    """A third of all rows, and most of a small language's, are copies of one text that is no prose."""
    docs = many_prose(5)
    docs += [(1000 + i, ODD[kind][0], "de") for i in range(85)]
    shape = {x.doc_id: x["shape"] for x in text_quality(spark.createDataFrame(docs, DOCS), common(spark)).collect()}
    assert Counter(shape[i] for i in range(1000, 1085)) == {kind: 85}
    assert all(shape[i] == "prose" for i, *_ in docs if i < 1000)


@pytest.mark.parametrize("copies", [2, 20, 85])
def test_copies_teach_no_letters(spark, copies):
    """Copies of random letters in sentences, in all ways of tagging; at most a third of all rows."""
    r = random.Random(8)
    junk = " ".join(" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 8))) for _ in range(9)).capitalize() + "." for _ in range(8))
    docs = many_prose(6) + [(1000 + i, junk, ("en", "EN", " en-GB", None, "xx")[i % 5]) for i in range(copies)]
    shape = {x.doc_id: x["shape"] for x in text_quality(spark.createDataFrame(docs, DOCS), common(spark)).collect()}
    assert Counter(shape[i] for i in range(1000, 1000 + copies)) == {"junk": copies}
    assert all(shape[i] == "prose" for i, *_ in docs if i < 1000)


def test_the_distance_decides(spark):
    """However clear the signs of a shape, no text within the cutoff has one; all of a text in items puts it beyond, a few items don't."""
    docs = many_prose(7) + [(900, ODD["list"][0], "en"), (901, " ".join(PROSE[:4]) + "\n\n- red coat\n- roof", "en")]
    df, words = spark.createDataFrame(docs, DOCS), common(spark)
    assert all(x["shape"] == "prose" for x in text_quality(df, words, 1e12).collect())
    rows = {x.doc_id: x for x in text_quality(df, words).collect()}
    assert rows[900]["shape"] == "list" and rows[901]["shape"] == "prose" and 0 < rows[901].list_share < 0.3
    assert text_quality(df, words, rows[900].distance).where("doc_id = 900").first()["shape"] == "prose"


def test_no_length_changes_a_class():
    for n in (1, 100, 5000):
        assert _is_name("7" * n) and _is_name("a" * n + "7.jpg") and not _is_name("a" * n + ".jpg") and not _is_name("x" * n)
        assert _named("a" * n + ": " + "b" * n) == ("a" * n, "b" * n)
    assert _named("no name") is None and _named(": x") is None and _named("10:30 o'clock") is None and _named("a=b") is None and _named("a =\tb") == ("a", "b") and _named("a = b") == ("a", "b")


def test_repeated_with_changes():
    r = random.Random(1)
    piece = " ".join(r.choices("abcdefghijk lmno pqrs tu".split(), k=12)) + " then all of it went on."
    text = " ".join(piece if i % 3 else piece.replace("then", f"th{i % 10}n") for i in range(12)).lower()
    assert repeated(text, text.split(), "") > 0.9
    assert repeated(" ".join(PROSE).lower(), " ".join(PROSE).split(), "") == 0.0 and repeated("word", ["word"], "") == 0.0
    assert repeated("我们比较了左右两张。" * 9, [], "我们比较了左右两张" * 9) > 0.9


def test_quality_of_nothing(spark):
    words = spark.createDataFrame([], "lang string, word string")
    assert text_quality(spark.createDataFrame([], DOCS), words).collect() == []
    rows = text_quality(spark.createDataFrame([(1, "some text here", "en"), (2, None, None)], DOCS), words).collect()
    assert {r.doc_id: r.n_words for r in rows} == {1: 3, 2: 0}


def test_cutoff():
    assert abs(chi2_quantile(0.05, 10) - 18.307) < 0.05 and CUTOFF > chi2_quantile(0.05, len(STATISTICS))


def test_long_runs_take_little_time():
    import time

    began = time.time()
    for unit in (" ", "-", "7", "a", "a1.", "- ", "a,", " • ", "[", "a:", "\t", "\n", "'", "<a", "&", "|", "0a ", "。", "é", "x=", "- a\n", "1 "):
        for end in ("", "¤", "x", "x."):
            text = unit * (60_000 // len(unit)) + end
            if text.strip():
                measure(text)
    assert time.time() - began < 20
