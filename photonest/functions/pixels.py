"""Measures of one image as numpy kernels; ``rgb`` is an array [height, width, 3] of 0..255."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# Reference scales of the measures.
LAPLACIAN_REF, COLOR_REF = 1500.0, 90.0
DARK, BRIGHT = 8, 247


def gray(rgb: np.ndarray) -> np.ndarray:
    # Elementwise, not as a matrix product, whose last digits (later truncated) differ between machines.
    r, g, b = (rgb[..., i].astype(np.float64) for i in range(3))
    return 0.299 * r + 0.587 * g + 0.114 * b


def _unit(x: float) -> float:
    return float(min(1.0, max(0.0, x)))


def laplacian_variance(g: np.ndarray) -> float:
    if min(g.shape) < 3:
        return 0.0
    middle = g[1:-1, 1:-1]
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * middle).var())


def sharpness(g: np.ndarray) -> float:
    return _unit(math.log1p(laplacian_variance(g)) / math.log1p(LAPLACIAN_REF))


def exposure(g: np.ndarray) -> dict[str, float]:
    bright = float(g.mean() / 255)
    clipped = float(((g <= DARK) | (g >= BRIGHT)).mean())
    penalty = 0.5 * _unit(abs(bright - 0.5) / 0.5) + 0.5 * _unit(4 * clipped)
    return {"brightness": bright, "contrast": _unit(float(g.std() / 127.5)), "clipping": clipped, "exposure_penalty": penalty}


def colorfulness(rgb: np.ndarray) -> float:
    r, g, b = (rgb[..., i].astype(np.float64) for i in range(3))
    rg, yb = r - g, 0.5 * (r + g) - b
    spread = math.sqrt(rg.var() + yb.var()) + 0.3 * math.hypot(rg.mean(), yb.mean())
    return _unit(spread / COLOR_REF)


def color_cast(rgb: np.ndarray) -> float:
    """1 for neutral highlights; 1 too where there is nothing to judge by (an all-black frame included)."""
    light = gray(rgb)
    usable = light < 250
    if usable.mean() < 0.02:
        return 1.0
    pixels, light = rgb[usable].astype(np.float64), light[usable]
    top = pixels[light >= np.quantile(light, 0.95)]
    if (top.max(axis=1) - top.min(axis=1)).mean() > 40:
        return 1.0
    mean = top.mean(axis=0)
    if mean.mean() == 0:
        return 1.0
    return _unit(1 - (mean / mean.mean()).std() * 255 / 40)


def gradients(g: np.ndarray) -> np.ndarray:
    return np.abs(np.diff(g, axis=1, append=g[:, -1:])) + np.abs(np.diff(g, axis=0, append=g[-1:]))


def composition(g: np.ndarray) -> float:
    """Gradient energy near the thirds' crossings, and how unevenly it lies over a 3 x 3 grid."""
    edges = gradients(g)
    ys, xs = ([0, n // 3, 2 * n // 3, n] for n in g.shape)
    cells = np.array([[edges[ys[i] : ys[i + 1], xs[j] : xs[j + 1]].sum() for j in range(3)] for i in range(3)])
    total = cells.sum()
    if total <= 0:
        return 0.0
    share = cells / total
    corners = share[0, 0] + share[0, 2] + share[2, 0] + share[2, 2]
    full = share[share > 0]
    uneven = 1 + float((full * np.log(full)).sum()) / math.log(9)
    return _unit(0.6 * _unit(corners / 0.55) + 0.4 * _unit(uneven / 0.03))


def box3(a: np.ndarray) -> np.ndarray:
    p = np.pad(a, 1, mode="edge")
    h, w = a.shape
    return sum(p[y : y + h, x : x + w] for y in range(3) for x in range(3)) / 9


@lru_cache(maxsize=64)
def _kernel(n: int, size: int, kind: str) -> np.ndarray:
    """Resampling kernel [size, n], a triangle or Lanczos-3, widened when shrinking; its rows do not add up to one yet."""
    scale = n / size
    wide = max(1.0, scale)
    reach = (1.0 if kind == "triangle" else 3.0) * wide
    centre = (np.arange(size) + 0.5) * n / size
    x = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / wide
    if kind == "triangle":
        k = np.maximum(0, 1 - np.abs(x))
    else:
        k = np.vectorize(_lanczos, otypes=[float])(x)
    k[np.abs(x) * wide > reach] = 0
    return k


def _lanczos(x: float) -> float:
    if abs(x) < 1e-12:
        return 1.0
    return math.sin(math.pi * x) / (math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * x / 3) if abs(x) < 3 else 0.0


def _resampled(a: np.ndarray, size: int, kind: str) -> np.ndarray:
    """Rows of bytes resampled to ``size`` and rounded: halves to even with the triangle, up with Lanczos.

    Sums go from left to right, not as a matrix product, so that what is a half but for rounding (the middle of a row whose
    pixels pair up to one odd sum) does not depend on the machine.
    """
    k = _kernel(a.shape[1], size, kind)
    if kind == "triangle":
        return np.clip(np.rint(a @ (k / k.sum(axis=1, keepdims=True)).T), 0, 255)
    total, weight = np.zeros((len(a), size)), np.zeros(size)
    for i in range(a.shape[1]):
        total += a[:, i, None] * k[:, i]
        weight += k[:, i]
    v = np.clip(total / weight, 0, 255)
    return np.floor(v) + (v - np.floor(v) >= 0.5)


def resize(a: np.ndarray, height: int, width: int, kind: str = "triangle") -> np.ndarray:
    """Bytes resampled to height x width, rounded between passes."""
    a = np.clip(a, 0, 255).astype(np.uint8).astype(np.float64)
    return _resampled(_resampled(a, width, kind).T, height, kind).T


def saliency(g: np.ndarray, size: int = 64) -> np.ndarray:
    """Spectral-residual saliency in [0, 1]; zeros for a flat image.

    Frequencies that rounding alone keeps from zero count as zero, as their phase would depend on the machine.
    """
    small = resize(g, size, size) if g.shape != (size, size) else g
    if small.std() < 1e-6:
        return np.zeros((size, size))
    f = np.fft.fft2(small)
    f[np.abs(f) < 1e-9 * np.abs(f).max()] = 0
    log = np.log(np.abs(f) + 1e-8)
    back = box3(np.abs(np.fft.ifft2(np.exp(log - box3(log) + 1j * np.angle(f)))) ** 2)
    low, high = back.min(), back.max()
    return np.zeros((size, size)) if high - low < 1e-12 else (back - low) / (high - low)


def concentration(s: np.ndarray) -> float:
    total = s.sum()
    if total <= 0:
        return 0.0
    p = s[s > 0] / total
    return _unit(1 + float((p * np.log(p)).sum()) / math.log(s.size))


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    norm = math.sqrt((a * a).sum() * (b * b).sum())
    return 0.0 if norm < 1e-12 else float((a * b).sum() / norm)


def subject_isolation(g: np.ndarray, size: int = 64) -> float:
    s = saliency(g, size)
    detail = box3(resize(gradients(g), size, size))
    return _unit((concentration(s) + (correlation(s, detail) + 1) / 2) / 2)


def dhash(rgb: np.ndarray) -> int:
    """64 bits, signed: left neighbour brighter than right, rows first, highest bit first."""
    r, g, b = (rgb[..., i].astype(np.int64) for i in range(3))
    luma = (r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16
    small = resize(luma, 8, 9, "lanczos")
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    value = int(np.packbits(bits).view(">u8")[0])
    return value - (1 << 64) if value >> 63 else value


def measure(rgb: np.ndarray, map_size: int = 64) -> dict[str, float]:
    """Every measure of one image."""
    g = gray(rgb)
    return {
        "laplacian_variance": laplacian_variance(g), "sharpness": sharpness(g), **exposure(g),
        "colorfulness": colorfulness(rgb), "color_cast": color_cast(rgb), "composition": composition(g),
        "subject_isolation": subject_isolation(g, map_size), "phash": dhash(rgb),
    }
