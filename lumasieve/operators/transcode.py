"""Display copies of images: reduced, written beside and renamed into place; copies that are there already are kept."""

from __future__ import annotations

import io
import os

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.photo import cache_key
from ..runtime import ship

# Longest side and quality of a display copy.
MOST, QUALITY = 4096, 90
RESULT = "id string, dest string, width int, height int, error string"


def fitted(width: int, height: int, most: int) -> tuple[int, int]:
    most = max(1, most)
    longest = max(width, height)
    if longest <= most:
        return width, height
    return max(1, round(width * (most / longest))), max(1, round(height * (most / longest)))


def transcode_file(path: str, dest: str, most: int = MOST) -> tuple[int, int]:
    """Write a JPEG copy (with Pillow), or a PNG copy where only this package's PNG codec is there and ``dest`` ends in .png."""
    from ..sources import images

    with open(path, "rb") as f:
        data = f.read()
    if images.Image is not None:
        with images.Image.open(io.BytesIO(data)) as img:
            rgb = img.convert("RGB")
        size = fitted(*rgb.size, most)
        if size != rgb.size:
            rgb = rgb.resize(size, images.Image.Resampling.LANCZOS)
        buffer = io.BytesIO()
        rgb.save(buffer, "JPEG", quality=QUALITY)
        out = buffer.getvalue()
    elif dest.lower().endswith(".png"):
        import numpy as np

        from ..functions.pixels import resize

        pixels = images.decode(data)
        size = fitted(pixels.shape[1], pixels.shape[0], most)
        planes = [resize(pixels[:, :, c], size[1], size[0]) if size != (pixels.shape[1], pixels.shape[0]) else pixels[:, :, c] for c in range(pixels.shape[2])]
        out = images.encode_png(np.stack(planes, 2) if len(planes) == 3 else planes[0])
    else:
        raise ValueError("no JPEG encoder is installed")
    os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
    with open(f"{dest}.part", "wb") as f:
        f.write(out)
    os.replace(f"{dest}.part", dest)
    return size


def transcode(files: DataFrame, folder: str, most: int = MOST, ending: str = "jpg") -> DataFrame:
    """(id, dest, width, height, error) of files (id, path, mtime_ns). Copies are named after path and time of change; an existing one is kept
    (width and height are null then). A file that fails has an error. Writing is an effect: use the result once."""
    ship(files.sparkSession)
    named = files.select("id", "path", F.concat(F.lit(f"{folder}/"), cache_key(F.col("path"), F.col("mtime_ns")), F.lit(f".{ending}")).alias("dest"))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if os.path.exists(r.dest):
                    rows.append((r.id, r.dest, None, None, None))
                    continue
                try:
                    rows.append((r.id, r.dest, *transcode_file(r.path, r.dest, most), None))
                except Exception as e:  # one file's failure is its own
                    if os.path.exists(f"{r.dest}.part"):
                        os.remove(f"{r.dest}.part")
                    rows.append((r.id, r.dest, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "dest", "width", "height", "error"], dtype=object)

    return named.mapInPandas(run, RESULT)
