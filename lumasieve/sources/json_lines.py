"""Requests and responses as JSON lines: {id, op, payload} in, {id, result} or {id, error} out, one line each.

    python -m lumasieve.sources.json_lines < requests > responses
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F


def _analyze(payload: dict) -> dict:
    from ..operators.analysis import features

    # Names of the thresholds that a request may set, and of the results.
    names = {"blurVarThreshold": "blur_threshold", "overMean": "over_mean", "underMean": "under_mean", "clipRatio": "clip_ratio", "normMaxSide": "norm_side"}
    with open(payload["path"], "rb") as f:
        got = features(f.read(), **{v: payload[k] for k, v in names.items() if k in payload})
    return {"shotAt": got["shot_at"], "blurScore": got["blur_score"], "isBlurry": got["is_blurry"], "exposureScore": got["exposure_score"], "exposureFlag": got["exposure_flag"], "phash": got["phash"]}


def _transcode(payload: dict) -> dict:
    from ..operators.transcode import MOST, transcode_file

    width, height = transcode_file(payload["path"], payload["dest"], payload.get("maxSide", MOST))
    return {"dest": payload["dest"], "width": width, "height": height}


OPERATIONS: dict[str, Callable[[dict], object]] = {"echo": lambda payload: payload["text"], "analyze": _analyze, "transcode": _transcode}


def respond(line: str) -> str:
    """The response to one request. Whatever goes wrong is an error response; a result with a number that isn't finite is one too."""
    key = None
    try:
        request = json.loads(line)
        key = request.get("id")
        if request.get("op") not in OPERATIONS:
            raise ValueError(f"unknown op {request.get('op')}")
        return json.dumps({"id": key, "result": OPERATIONS[request["op"]](request.get("payload") or {})}, allow_nan=False)
    except Exception as e:
        return json.dumps({"id": key, "error": f"{type(e).__name__}: {e}"})


RESULT = "shotAt string, blurScore double, isBlurry boolean, exposureScore double, exposureFlag string, phash string"


def read_outcomes(responses: DataFrame) -> DataFrame:
    """Outcomes (see operators.analysis) of a column ``value`` of responses to analyze requests, whose ids are photo ids. A response that
    can't be read, or lacks a result, is a failure."""
    read = F.from_json("value", f"id string, error string, result struct<{RESULT.replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>")
    r = lambda k: F.col("r.result." + k)
    ok = F.col("r.result").isNotNull() & r("phash").isNotNull()
    error = F.when(~F.coalesce(ok, F.lit(False)), F.coalesce("r.error", F.lit("ValueError: malformed result")))
    return responses.withColumn("r", read).select(
        F.col("r.id").alias("id"), F.coalesce(ok, F.lit(False)).alias("ok"), r("shotAt").alias("shot_at"), r("blurScore").alias("blur_score"), r("isBlurry").alias("is_blurry"),
        r("exposureScore").alias("exposure_score"), r("exposureFlag").alias("exposure_flag"), r("phash").alias("phash"), error.alias("error"))


def main() -> None:
    for line in sys.stdin:
        if line.strip():
            print(respond(line), flush=True)


if __name__ == "__main__":
    main()
