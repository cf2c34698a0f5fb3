"""Quality statistics of texts, their distance from prose, and the shape of what isn't prose.

Each different text is looked at once in Python, which gives the values of STATISTICS, and its letter runs for the letter counts of its
language. For each language the mean and covariance of prose are estimated robustly over all different texts: medians and median deviations
give a first core of texts; the mean and covariance of the core give the distances by which the next core is chosen, until it no longer changes.
A text's squared Mahalanobis distance from its language's prose alone decides whether it is prose; it splits into one contribution a statistic.
An outlier gets the name of what is farthest from prose about it: the letters, the repetition, or the look of its lines as items, rows or noise.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import Stash, ship
from .text_shape import EVIDENCE, LETTERS, NO_LETTERS, STATISTICS, Letters, Vocabulary, language, measure, plain

#: Share of prose beyond the cutoff distance, and beyond the core, if prose were normal.
TAIL, CORE_TAIL = 0.001, 0.025
#: Weight of all languages' covariance against a language's own, in texts; rounds of the core after which it is taken as it is.
POOLED, ROUNDS = 60, 20
_D = len(STATISTICS)
_AT = {k: i for i, k in enumerate(STATISTICS)}
#: Smallest deviation of each statistic in prose. Length says little, in short texts all lines or none end in punctuation, and a few sentences are few letters.
FLOORS = {
    "log_words": 1.0, "mean_word_length": 0.2, "symbol_ratio": 0.05, "digit_ratio": 0.05, "punctuated_lines": 0.25, "sentence_length": 0.15, "short_lines": 0.15, "repeated": 0.1, "common_share": 0.06, "letter_fit": 0.2,
}
FLOOR = np.array([FLOORS[k] for k in STATISTICS])
#: Deviation of the shares in EVIDENCE, which prose has little of.
EVIDENCE_FLOOR = 0.15
_NAMES = ("list", "table", "junk", "junk", "junk")  # for the first three of EVIDENCE, for letters of no language, for repetition


def chi2_quantile(tail: float, d: int) -> float:
    """The value that a chi-squared variable of d degrees exceeds with chance ``tail`` (Wilson and Hilferty)."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(1 - tail)
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


CUTOFF = chi2_quantile(TAIL, _D)
#: Squared deviations that one sign of a shape must exceed to name it.
SIGN = chi2_quantile(TAIL, 1)


def vocabulary(common_words: DataFrame) -> Vocabulary:
    """The list of common words, a reference table of a few hundred words a language, on the driver."""
    words: dict[str, set[str]] = {}
    for r in common_words.where("lang is not null and word is not null").select("lang", "word").distinct().collect():
        words.setdefault(r.lang.strip().lower()[:2], set()).add(plain(r.word.strip()))
    return Vocabulary({k: frozenset(v) for k, v in words.items()})


def _tag(lang: Column, known: list[str]) -> Column:
    """The known language that a row states, else the empty text."""
    tag = F.lower(F.substring(F.regexp_replace(lang, r"(?U)^\s+|\s+\z", ""), 1, 2))
    return F.when(tag.isin(known), tag).otherwise("") if known else F.lit("")


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    """A list column of arrays of numbers or texts; None stays null."""
    if not rows or isinstance(rows[0], list) or any(r is None for r in rows):
        return pa.array(rows, pa.list_(kind))
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(rows)).cast(kind))


_MEASURED = "key binary, tags array<string>, lang string, n_words bigint, stats array<double>, evidence array<double>, run array<int>, n array<bigint>"
_FULL = "key binary, tags array<string>, lang string, n_words bigint, stats array<double>, evidence array<double>"


def _measured(docs: DataFrame, common: Vocabulary, known: list[str]) -> DataFrame:
    """One row for each different text and language found for it, and one row without key for each language of a partition, with its letter counts.

    tags: the tags of the text's rows for which that language was found. letter_fit is left open, as it takes the counts of all texts.
    """
    # Flags rather than a set of tags, so that copies are gathered by hashing in fixed space, before the shuffle too.
    tag = _tag(F.col("lang"), known)
    texts = docs.where("text is not null").groupBy("text").agg(*[F.max(tag == k).alias(f"tag{i}") for i, k in enumerate(["", *known])])

    def look(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = []
                for text, *has in zip(*(c.to_pylist() for c in part.columns)):
                    if not text.strip():
                        continue
                    m = measure(text)
                    run, n = np.unique(m.runs, return_counts=True)
                    tags: dict[str, list[str]] = {}
                    for k, there in zip(["", *known], has):
                        if there:
                            tags.setdefault(language(k, m.words, m.han, common), []).append(k)
                    key = hashlib.md5(text.encode()).digest()
                    for lang, own in tags.items():
                        share = common.share(m.words, m.han, lang) if lang in common.words else 0.0
                        rows.append((key, own, lang, m.n_words, np.array([*m.stats, share, NO_LETTERS]), np.array(m.evidence), run, n))
                        if lang not in counts:
                            counts[lang] = np.zeros(LETTERS**3, np.int64)
                        counts[lang][run] += n
                if rows:
                    yield _batch(*zip(*rows))
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield _batch([None], [None], [lang], [None], [None], [None], [at], [n[at]])

    return texts.mapInArrow(look, _MEASURED)


def _batch(key, tags, lang, n_words, stats, evidence, run, n) -> pa.RecordBatch:
    f8 = pa.float64()
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.binary()), _lists(list(tags), pa.string()), pa.array(lang, pa.string()), pa.array(n_words, pa.int64()), _lists(list(stats), f8), _lists(list(evidence), f8), _lists(list(run), pa.int32()), _lists(list(n), pa.int64())],
        names=["key", "tags", "lang", "n_words", "stats", "evidence", "run", "n"])


def _letters(measured: DataFrame) -> dict[str, Letters]:
    """By language the counts of runs of three letters. At most LETTERS ** 3 counts a language reach the driver."""
    each = measured.where("key is null").select("lang", F.explode(F.arrays_zip("run", "n")).alias("v"))
    found: dict[str, np.ndarray] = {}
    for r in each.groupBy("lang", "v.run").agg(F.sum("v.n").alias("n")).collect():
        found.setdefault(r.lang, np.zeros(LETTERS**3))[r.run] = r.n
    return {k: Letters(v) for k, v in found.items() if k not in ("zh", "other")}


def _fitted(measured: DataFrame, letters) -> DataFrame:
    """The texts' rows with letter_fit, without their letter runs. letters: a broadcast of what _letters gives."""

    def fit(batches):
        for b in batches:
            stats = b["stats"].flatten().to_numpy().reshape(-1, _D).copy()
            at, run, n = b["run"].offsets.to_numpy(), b["run"].values.to_numpy(), b["n"].values.to_numpy()
            for i, lang in enumerate(b["lang"].to_pylist()):
                if lang in letters.value:
                    stats[i, _AT["letter_fit"]] = letters.value[lang].fit(run[at[i] : at[i + 1]], n[at[i] : at[i + 1]])
            cols = [b["key"], b["tags"], b["lang"], b["n_words"], _matrix_column(stats), b["evidence"]]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "tags", "lang", "n_words", "stats", "evidence"])

    return measured.where("key is not null").mapInArrow(fit, _FULL)


def _matrix_column(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def _matrix(column, width: int = _D) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _distances(x: np.ndarray, langs: np.ndarray, models: dict) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances from the own language's prose, and their parts by statistic, which sum to them."""
    parts = np.zeros_like(x)
    for lang in set(langs.tolist()):
        own = langs == lang
        mean, inverse = models[lang]
        delta = x[own] - mean
        parts[own] = delta * (delta @ inverse)
    return parts.sum(1), parts


def _core_sums(stats: DataFrame, models: dict, limit: float) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """By language the number, the mean and the covariance of the texts within ``limit`` of the language's model."""
    upper = np.triu_indices(_D)

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, x = np.array(b["lang"].to_pylist(), object), _matrix(b["stats"])
            near = _distances(x, langs, models)[0] <= limit
            for lang in set(langs[near].tolist()):
                z = x[near & (langs == lang)] - models[lang][0]
                got = np.concatenate([[len(z)], z.sum(0), (z.T @ z)[upper]])
                sums[lang] = sums.get(lang, 0) + got
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), _matrix_column(np.stack(list(sums.values())))], names=["lang", "v"])

    size = 1 + _D + len(upper[0])
    whole = stats.select("lang", "stats").mapInArrow(add, "lang string, v array<double>").groupBy("lang").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(size)])
    found = {}
    for r in whole.collect():
        n, shift = r[1], np.array(r[2 : 2 + _D]) / r[1]
        second = np.zeros((_D, _D))
        second[upper] = r[2 + _D :]
        second += np.triu(second, 1).T
        found[r.lang] = n, models[r.lang][0] + shift, second / n - np.outer(shift, shift)
    return found


def prose_models(stats: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By language the mean and inverse covariance of prose. stats: (lang, stats), a written table of one row for each text and language.

    The core is chosen anew until no language's changes (ROUNDS times at most); a round is one job, and sends one row a language to the driver.
    """
    half = lambda cols: [F.percentile_approx(c, 0.5, 1000).alias(f"m{i}") for i, c in enumerate(cols)]
    values = [F.col("stats")[i] for i in range(_D)]
    median = {r.lang: np.array(r[1:], float) for r in stats.groupBy("lang").agg(*half(values)).collect()}
    if not median:
        return {}
    at = F.create_map(*[x for k, v in median.items() for x in (F.lit(k), F.array(*map(F.lit, v.tolist())))])
    spread = {r.lang: np.array(r[1:], float) for r in stats.withColumn("m", at[F.col("lang")]).groupBy("lang").agg(*half([F.abs(v - F.col("m")[i]) for i, v in enumerate(values)])).collect()}
    models = {k: (v, np.diag(1 / (1.4826 * spread[k] + FLOOR) ** 2)) for k, v in median.items()}
    sizes = None
    for _ in range(ROUNDS):
        found = _core_sums(stats, models, chi2_quantile(CORE_TAIL, _D))
        total = sum(n for n, *_ in found.values())
        pooled = sum(n * cov for n, _, cov in found.values()) / total if total else np.zeros((_D, _D))
        new = {}
        for k in models:
            n, mean, cov = found.get(k, (0, median[k], pooled))
            new[k] = mean, np.linalg.inv((n * cov + POOLED * pooled) / (n + POOLED) + np.diag(FLOOR**2))
        moved = max(float(np.abs((new[k][0] - models[k][0]) / FLOOR).max()) for k in models)
        before, sizes, models = sizes, {k: n for k, (n, *_) in found.items()}, new
        if sizes == before and moved < 1e-6:
            break
    return models


def text_quality(docs: DataFrame, common_words: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, lang, n_words, STATISTICS, EVIDENCE, distance, from_..., shape) of every text.

    lang is the language found: the row's own if it is a known one and the text doesn't speak for another. log_words is ln(1 + words), sentence_length
    likewise; EVIDENCE are shares of the characters that aren't blank, see text_shape. distance is the squared Mahalanobis distance from the language's prose over all
    STATISTICS, and the from_ columns, one a statistic, sum to it. shape is prose up to ``cutoff``; beyond it list, table or junk, after the largest of the
    standardised deviations of the shares, letter_fit (if low, for what the shares don't tell) and repeated; an outlier with none of them beyond
    SIGN, such as a single word, is prose of an unusual kind. EVIDENCE has no part in the distance.

    A null, empty or blank text has no words and nulls otherwise. Repeated rows each come out; the models count a text once, however
    many rows have it (texts that differ in any character are different ones). A language with few texts borrows from all
    languages' covariance. Whole texts are read, however long. Other columns don't matter; empty tables give no row.
    """
    ship(docs.sparkSession)
    stash = Stash(docs.sparkSession, "quality")
    common = vocabulary(common_words)
    known = sorted(common.words)
    measured = stash.put(_measured(docs.select("text", "lang"), common, known))
    letters = docs.sparkSession.sparkContext.broadcast(_letters(measured))
    full = stash.put(_fitted(measured, letters))
    stash.drop(measured)
    models = prose_models(full.select("lang", "stats"))

    def score(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, evidence = _matrix(b["stats"]), _matrix(b["evidence"], len(EVIDENCE))
            d, parts = _distances(x, np.array(b["lang"].to_pylist(), object), models)
            fit = _AT["letter_fit"]
            low = x[:, fit] < np.array([models[k][0][fit] for k in b["lang"].to_pylist()])
            told = evidence[:, :3].sum(1) - evidence[:, 3]  # items and values have letters of their own; many in one line are too weak a sign
            away = np.column_stack([(evidence[:, :3] / EVIDENCE_FLOOR) ** 2, np.where(low, parts[:, fit], 0.0) * (1 - told), parts[:, _AT["repeated"]]])
            far = (d > cutoff) & (away.max(1) > SIGN)
            shape = [_NAMES[k] if out else "prose" for k, out in zip(away.argmax(1).tolist(), far.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b["key"], b["tags"], b["lang"], b["n_words"], b["stats"], b["evidence"], pa.array(d), _matrix_column(parts), pa.array(shape, pa.string())], names=["key", "tags", "lang", "n_words", "stats", "evidence", "distance", "parts", "shape"]
            )

    scored = full.mapInArrow(score, f"{_FULL}, distance double, parts array<double>, shape string")
    named = [F.col("stats")[i].alias(k) for i, k in enumerate(STATISTICS)] + [F.col("evidence")[i].alias(k) for i, k in enumerate(EVIDENCE)]
    parts = [F.col("parts")[i].alias(f"from_{k}") for i, k in enumerate(STATISTICS)]
    wide = scored.select("key", F.explode("tags").alias("tag"), F.col("lang").alias("found"), "n_words", *named, "distance", *parts, "shape")
    rows = docs.select("doc_id", F.unhex(F.md5("text")).alias("key"), _tag(F.col("lang"), known).alias("tag"))
    shown = [c for c in wide.columns if c not in ("key", "tag", "found", "n_words")]
    return rows.join(wide, ["key", "tag"], "left").select("doc_id", F.col("found").alias("lang"), F.coalesce("n_words", F.lit(0)).alias("n_words"), *shown)


def text_shapes(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, shape) of the texts that are no prose: list, table or junk; see text_quality."""
    return text_quality(docs, common_words).select("doc_id", "shape").where(F.col("shape").isin("list", "table", "junk"))
