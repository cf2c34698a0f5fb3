"""Scalar functions on photo columns, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Files taken in, the ones that need transcoding for display, thresholds of the exposure flag and of blur.
SUPPORTED = ("jpg", "jpeg", "png", "heic", "heif")
HEIC = ("heic", "heif")
OVER_MEAN, UNDER_MEAN, CLIP_RATIO, BLUR_VARIANCE = 0.80, 0.20, 0.50, 100.0
MAX_RENAMES = 9999


def is_supported(path: Column) -> Column:
    """Whether a file's extension is a supported one; a name that is nothing but an extension has none."""
    return path.rlike(r"(?i)[^/\\]\.(?:" + "|".join(SUPPORTED) + r")\z")


def file_name(path: Column) -> Column:
    """The part after the last slash or backslash, or the whole path if that part is empty."""
    last = F.regexp_extract(path, r"([^/\\]*)\z", 1)
    return F.coalesce(F.nullif(last, F.lit("")), path)


def is_heic(path: Column) -> Column:
    return file_name(path).rlike(r"(?i)\.(?:" + "|".join(HEIC) + r")\z")


def photo_id(project: Column, path: Column) -> Column:
    return F.sha2(F.concat(project, F.lit("\n"), path), 256)


LANES = tuple(f"lane{i}" for i in range(4))


def digest_lanes(member_id: Column) -> list[Column]:
    """Aggregates: the members' own digests combined by exclusive or in four lanes, so that partial results can be merged by ``bit_xor``."""
    whole = F.sha2(member_id, 256)
    return [F.bit_xor(F.conv(F.substring(whole, 16 * i + 1, 16), 16, -10).cast("bigint")).alias(lane) for i, lane in enumerate(LANES)]


def set_digest(method: str, count: Column, lanes: list[Column]) -> Column:
    """64 hexadecimal digits that depend on the method and the set of (different) member ids alone, from their number and merged lanes."""
    return F.sha2(F.concat_ws("\n", F.lit(method), count.cast("string"), *[lane.cast("string") for lane in lanes]), 256)


def cache_key(path: Column, mtime_ns: Column) -> Column:
    return F.sha2(F.concat(path, F.lit("|"), mtime_ns.cast("string")), 256)


def parse_phash(text: Column) -> Column:
    """A 16-digit hexadecimal hash as a signed whole number, else null."""
    return F.when(text.rlike(r"^[0-9a-fA-F]{16}\z"), F.conv(text, 16, -10).cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def int_to_bool(value: Column) -> Column:
    return value != 0


def exposure_flag(mean: Column, bright: Column, dark: Column, over=OVER_MEAN, under=UNDER_MEAN, clip=CLIP_RATIO) -> Column:
    """over before under before normal: by mean brightness, or by the share of clipped pixels."""
    return F.when((mean > over) | (bright >= clip), "over").when((mean < under) | (dark >= clip), "under").otherwise("normal")


def is_blurry(variance: Column, threshold: float = BLUR_VARIANCE) -> Column:
    return variance < threshold


def quality_badges(blurry: Column, flag: Column) -> Column:
    """Ordered list of what is wrong with a photo: blur, then over or under."""
    return F.array_compact(F.array(F.when(blurry, "blur"), F.when(flag.isin("over", "under"), flag)))


def fit_side(side: Column, other: Column, most: int) -> Column:
    """A side's length after scaling so that the longest is at most ``most``; halves go to even, and at least 1 is left."""
    longest, cap = F.greatest(side, other), F.lit(max(1, most))
    scaled = F.greatest(F.lit(1), F.bround(side * (cap / longest)).cast("int"))
    return F.when(longest > cap, scaled).otherwise(side.cast("int"))


def name_parts(name: Column) -> tuple[Column, Column]:
    """Stem and ending of a file name; a name that begins with its only dot has no ending."""
    return tuple(F.regexp_extract(name, r"(?s)^(.+?)(\.[^.]*)?\z", i) for i in (1, 2))


def renamed(name: Column, n: Column) -> Column:
    """The n-th name for a file whose name is taken: 'stem (n).ext', for n = 0 the name itself."""
    stem, ext = name_parts(name)
    return F.when(n == 0, name).otherwise(F.concat(stem, F.lit(" ("), n.cast("string"), F.lit(")"), ext))


def percent(done: Column, total: Column) -> Column:
    """Progress in per cent, at most 100; null without total."""
    return F.when(total > 0, F.least(F.lit(100), F.floor(done / total * 100 + 0.5)).cast("int"))


def shown_date(text: Column, never: str) -> Column:
    """Minute of an ISO time in the session's zone; null gives ``never``, an unreadable text itself."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm"), text, F.lit(never))


def group_params(threshold: int, version: int = 1) -> Column:
    return F.to_json(F.struct(F.lit(threshold).alias("threshold"), F.lit(version).alias("version")))
