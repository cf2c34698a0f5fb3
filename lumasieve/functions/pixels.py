"""Image features of pixel arrays: grey levels, sharpness, exposure, perceptual hash."""

from __future__ import annotations

import functools

import numpy as np

from .photo import BLUR_VARIANCE, CLIP_RATIO, OVER_MEAN, UNDER_MEAN

# Longest side for sharpness and exposure, levels that count as clipped, weights of red, green and blue in grey.
NORM_SIDE, BRIGHT, DARK = 1024, 250, 5
LUMA = (0.299, 0.587, 0.114)


def grey(pixels: np.ndarray) -> np.ndarray:
    """Grey levels of an H x W x C byte array."""
    if pixels.ndim == 2:
        return pixels
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    return np.floor(pixels[:, :, :3].astype(np.float64) @ np.array(LUMA) + 0.5).astype(np.uint8)


@functools.lru_cache(64)
def _weights(old: int, new: int, reach: float, kernel: str) -> np.ndarray:
    """new x old matrix that resamples one axis with an antialiased kernel."""
    scale = old / new
    wide = max(1.0, scale)
    at = (np.arange(new)[:, None] + 0.5) * scale - 0.5
    x = np.abs(np.arange(old)[None, :] - at) / wide
    w = np.clip(1 - x, 0, None) if kernel == "linear" else np.where(x < reach, np.sinc(x) * np.sinc(x / reach), 0.0)
    return w / w.sum(1, keepdims=True)


def resize(levels: np.ndarray, height: int, width: int, kernel: str = "linear") -> np.ndarray:
    reach = 1.0 if kernel == "linear" else 3.0
    rows, cols = _weights(levels.shape[0], height, reach, kernel), _weights(levels.shape[1], width, reach, kernel)
    return np.clip(np.floor(rows @ levels.astype(np.float64) @ cols.T + 0.5), 0, 255).astype(np.uint8)


def normalised(levels: np.ndarray, most: int = NORM_SIDE) -> np.ndarray:
    """Grey levels, reduced so that the longest side is at most ``most``; never enlarged."""
    most = max(1, most)
    longest = max(levels.shape)
    if longest <= most:
        return levels
    return resize(levels, *[max(1, round(n * most / longest)) for n in levels.shape])


def blur(levels: np.ndarray, threshold: float = BLUR_VARIANCE) -> tuple[float, bool]:
    """Population variance of the four-neighbour Laplacian, and whether it is below the threshold. Too small an image has 0."""
    if min(levels.shape) < 3:
        return 0.0, True
    x = levels.astype(np.float64)
    response = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    score = float(response.var())
    return score, score < threshold


def exposure(levels: np.ndarray, over: float = OVER_MEAN, under: float = UNDER_MEAN, clip: float = CLIP_RATIO) -> tuple[float, str]:
    """Mean level from 0 to 1, and its flag; an image without pixels is normal."""
    if not levels.size:
        return 0.0, "normal"
    mean = float(levels.mean()) / 255
    bright, dark = float((levels >= BRIGHT).mean()), float((levels <= DARK).mean())
    if mean > over or bright >= clip:
        return mean, "over"
    return mean, "under" if mean < under or dark >= clip else "normal"


@functools.cache
def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def phash(levels: np.ndarray, side: int = 8, factor: int = 4) -> str:
    """64-bit perceptual hash: the low frequencies of a reduced image, each against their median, as 16 hexadecimal digits."""
    n = side * factor
    small = resize(levels, n, n, "lanczos").astype(np.float64)
    low = (_cosines(n) @ small @ _cosines(n).T)[:side, :side]
    bits = (low > np.median(low)).ravel()
    return f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"
