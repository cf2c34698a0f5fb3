"""Decoding of image bytes to arrays: by Pillow where it is installed, else PNG by this module; other formats then fail with an error text."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

try:
    from PIL import Image

    try:
        from pillow_heif import register_heif_opener

        register_heif_opener()
    except ImportError:
        pass
except ImportError:
    Image = None

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _unfilter(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG without their prediction filters."""
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel() if stride % step == 0 else line
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            left = [0] * step
            corner = [0] * step
            data, up = line.tolist(), above.tolist()
            for x in range(stride):
                a, b, c = left[x % step], up[x], corner[x % step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                data[x] = (data[x] + guess) & 255
                left[x % step], corner[x % step] = data[x], b
            line = np.array(data, np.uint8)
        elif kind:
            raise ValueError("unknown PNG filter")
        out[y] = above = line
    return out


def decode_png(data: bytes) -> np.ndarray:
    """Height x width x (1, 2, 3 or 4) bytes of a PNG that isn't interlaced; palettes become colours."""
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None:
        raise ValueError("PNG without header")
    width, height, depth, colour, _, _, interlaced = head
    if interlaced:
        raise ValueError("interlaced PNG")
    channels = _CHANNELS[colour]
    stride = (width * channels * depth + 7) // 8
    rows = _unfilter(zlib.decompress(b"".join(packed)), height, stride, max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(height, -1, depth)
        rows = np.packbits(np.pad(bits, ((0, 0), (0, 0), (8 - depth, 0))), axis=2)[:, :, 0][:, : width * channels]
        if colour != 3:
            rows = rows * (255 // ((1 << depth) - 1))
    pixels = rows.reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if colour == 3 else pixels


def encode_png(pixels: np.ndarray) -> bytes:
    """A grey (2-D) or colour (3-D, three channels) byte array as PNG."""
    colour = 2 if pixels.ndim == 3 else 0
    height, width = pixels.shape[:2]
    raw = np.hstack([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1).astype(np.uint8)]).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """Pixels of an image file's bytes, grey (H x W x 1) or colour (H x W x 3)."""
    if Image is not None:
        with Image.open(io.BytesIO(data)) as img:
            img.load()
            array = np.asarray(img if img.mode == "L" else img.convert("RGB"))
        return array if array.ndim == 3 else array[:, :, None]
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        pixels = decode_png(data)
        return pixels[:, :, : 1 if pixels.shape[2] < 3 else 3]
    raise ValueError("no decoder for this format is installed")
