"""Capture time from the EXIF block of JPEG, PNG, TIFF and HEIF bytes, without an imaging library."""

from __future__ import annotations

import datetime as dt
import struct

# Tags of the capture time, of the change time and of the sub-directory, and the written form.
TAKEN, CHANGED, SUB_DIRECTORY = 0x9003, 0x0132, 0x8769
FORM = "%Y:%m:%d %H:%M:%S"
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def iso_time(text: str | bytes | None) -> str | None:
    """'2026:05:24 10:30:00' as '2026-05-24T10:30:00'; anything that is no such date gives None."""
    if isinstance(text, bytes):
        text = text.decode("ascii", "ignore")
    if not isinstance(text, str):
        return None
    try:
        return dt.datetime.strptime(text.replace("\0", "").strip(), FORM).isoformat()
    except ValueError:
        return None


def _block(data: bytes) -> bytes | None:
    """The TIFF structure that holds the EXIF tags."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return data[at + 10 : at + 2 + size]
            if marker in (0xDA, 0xD9):
                return None
            at += 2 + size
        return None
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    if data[4:8] == b"ftyp":
        at = data.find(b"Exif\0\0")
        return data[at + 6 :] if at >= 0 else None
    return None


def _tags(block: bytes, at: int, order: str) -> dict[int, object]:
    out: dict[int, object] = {}
    (n,) = struct.unpack_from(order + "H", block, at)
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
        size = _SIZES.get(kind, 0) * count
        start = at + 10 + 12 * i
        if size > 4:
            (start,) = struct.unpack_from(order + "I", block, start)
        raw = block[start : start + size]
        if kind in (2, 7):
            out[tag] = raw
        elif kind in (3, 4) and count == 1 and len(raw) == size:
            out[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), raw)[0]
    return out


def shot_at(data: bytes) -> str | None:
    """Capture time as naive ISO text, or None. The original time counts even if it is malformed; the change time only without one."""
    try:
        block = _block(data)
        if not block:
            return None
        order = "<" if block[:2] == b"II" else ">"
        (first,) = struct.unpack_from(order + "I", block, 4)
        tags = _tags(block, first, order)
        sub = tags.get(SUB_DIRECTORY)
        taken = _tags(block, sub, order).get(TAKEN) if isinstance(sub, int) else None
        return iso_time(taken or tags.get(CHANGED))
    except (struct.error, IndexError):
        return None
