"""Compact, reversible form of text ids for shuffles.

An id of 64 lower-case hexadecimal digits becomes its 32 bytes; any other text keeps its UTF-8 bytes and
gets an end mark, so that no two texts share a form. The form serves equality only: texts are decoded
again wherever their byte order counts.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pack_id(col: Column) -> Column:
    raw = F.encode(col, "UTF-8")
    marked = F.when(F.octet_length(col) == 31, F.concat(raw, F.unhex(F.lit("0202")))).otherwise(F.concat(raw, F.unhex(F.lit("01"))))
    return F.when(col.rlike("^[0-9a-f]{64}\\z"), F.unhex(col)).otherwise(marked)


def unpack_id(col: Column) -> Column:
    size = F.octet_length(col)
    cut = F.when(F.hex(F.substring(col, -1, 1)) == "02", size - 2).otherwise(size - 1)
    return F.when(size == 32, F.lower(F.hex(col))).otherwise(F.decode(F.substring(col, F.lit(1), cut), "UTF-8"))
