"""Feature extraction from image files: one pass over each file, one row each, errors kept in the row."""

from __future__ import annotations

import math
import mmap
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..functions.photo import BLUR_VARIANCE, CLIP_RATIO, OVER_MEAN, UNDER_MEAN
from ..functions.pixels import NORM_SIDE, blur, exposure, grey, normalised, phash
from ..runtime import ship
from ..sources.exif import shot_at
from ..sources.images import decode

OUTCOMES = "id string, ok boolean, shot_at string, blur_score double, is_blurry boolean, exposure_score double, exposure_flag string, phash string, error string"
_NAMES = [x.split()[0] for x in OUTCOMES.split(", ")]


def pixel_features(pixels: np.ndarray, blur_threshold=BLUR_VARIANCE, over_mean=OVER_MEAN, under_mean=UNDER_MEAN, clip_ratio=CLIP_RATIO, norm_side=NORM_SIDE) -> dict:
    """Features of an H x W x C byte array. The hash is of the whole image, the rest of the reduced one."""
    levels = grey(pixels)
    small = normalised(levels, norm_side)
    score, blurry = blur(small, blur_threshold)
    mean, flag = exposure(small, over_mean, under_mean, clip_ratio)
    if not (math.isfinite(score) and math.isfinite(mean)):
        raise ValueError("a feature is no finite number")
    return {"blur_score": score, "is_blurry": blurry, "exposure_score": mean, "exposure_flag": flag, "phash": phash(levels)}


def features(data: bytes, **thresholds) -> dict:
    """All features of an image file's bytes, decoded once."""
    return {"shot_at": shot_at(data)} | pixel_features(decode(data), **thresholds)


def _outcome(key: str, read, thresholds: dict) -> dict:
    try:
        return {"id": key, "ok": True, "error": None} | features(read(), **thresholds)
    except Exception as e:  # a file that can't be analysed is a result, not a failure of the job
        return {"id": key, "ok": False, "error": f"{type(e).__name__}: {e}"}


def analyse(files: DataFrame, **thresholds) -> DataFrame:
    """Outcomes (see OUTCOMES) of files given by (id, path) or (id, content). A file that can't be read or decoded has ok false and an error text.

    Reading is what takes time, so files should be spread evenly: repartition before, if there are few partitions.
    """
    ship(files.sparkSession)
    has_content = "content" in files.columns

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if has_content:
                    rows.append(_outcome(r.id, lambda r=r: bytes(r.content), thresholds))
                else:

                    def read(path=r.path):
                        with open(path, "rb") as f:
                            return f.read()

                    rows.append(_outcome(r.id, read, thresholds))
            yield pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k in _NAMES})

    return files.select("id", "content" if has_content else "path").mapInPandas(run, OUTCOMES)


def analyse_folder(spark: SparkSession, folder: str, **thresholds) -> DataFrame:
    """Outcomes of the JPEG, PNG, GIF and BMP files below a folder, decoded by the JVM in Spark's image source; the id is the file's address.

    For clusters without an imaging library in Python. The source leaves out names that begin with a dot or an underscore; capture times are
    read from the file, wherever in it they are. A file that can't be decoded has ok false.
    """
    ship(spark)
    images = spark.read.format("image").option("recursiveFileLookup", True).load(folder).select("image.*")

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    if r.mode < 0:
                        raise ValueError("no image")
                    pixels = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                    colours = pixels[:, :, 2::-1] if r.nChannels >= 3 else pixels  # the source has blue first
                    rows.append({"id": r.origin, "ok": True, "shot_at": _time_of(r.origin)} | pixel_features(colours, **thresholds))
                except Exception as e:  # one file's failure is its own
                    rows.append({"id": r.origin, "ok": False, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame({k: pd.Series([r.get(k) for r in rows], dtype=object) for k in _NAMES})

    return images.mapInPandas(run, OUTCOMES)


def _time_of(address: str) -> str | None:
    path = unquote(address.removeprefix("file://"))
    try:
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:  # only what the parser looks at is read
            return shot_at(data)
    except (OSError, ValueError):  # an empty file can't be mapped
        return None
