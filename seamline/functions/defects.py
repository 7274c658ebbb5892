"""Synthetic defects by kind and level, as constant changes to an image of h by w."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds and what they look like: change of brightness at level 1, radius or width as a share of the image.
SPOTS = {"spot": (-25, 0.12), "big_spot": (-25, 0.25), "faint_spot": (-8, 0.15), "bright": (25, 0.12)}
STAINS = {"stain": (-15, 0.2), "gradient_stain": (-10, 0.4)}
LINES = {"scratch": [(1, 0.3)], "thin_scratch": [(1, 0.6)], "thick_scratch": [(2, 0.3)], "multi_scratch": [(1, 0.2), (1, 0.5), (1, 0.8)]}
KINDS = [*SPOTS, *STAINS, *LINES, "crack"]
#: Brightness ratios of a line, by level.
RATIOS = [1.0, 0.98, 0.95, 0.9, 0.8, 0.65, 0.5]


def change(kind: str, level: int, h: int, w: int) -> np.ndarray:
    """What a defect of a level (1 up) adds to each pixel."""
    y, x = np.mgrid[:h, :w].astype(float)
    away = np.hypot(y - (h - 1) * 0.4, x - (w - 1) * 0.6)
    if kind in SPOTS:
        by, r = SPOTS[kind]
        return np.where(away <= max(1.0, r * min(h, w)), by * level, 0.0)
    if kind in STAINS:
        by, r = STAINS[kind]
        fade = np.exp(-(away**2) / (2 * (r * min(h, w)) ** 2))
        return by * level * (fade * (x + 1) / w if kind == "gradient_stain" else fade)
    if kind in LINES:
        out = np.zeros((h, w))
        for width, at in LINES[kind]:
            row = int(at * (h - 1))
            out[row : row + width] = 20 * level
        return out
    out = np.zeros((h, w))
    for i in range(h):  # a crack wanders by one column every other row
        out[i, (w // 3 + i // 2) % w] = -30 * level
    return out


def injected(pixels: Column, kind: str, level: int, h: int, w: int) -> Column:
    """A flat image with a defect, kept within 0 to 255."""
    delta = F.array(*[F.lit(float(d)) for d in change(kind, level, h, w).ravel()])
    return F.zip_with(pixels, delta, lambda p, d: F.least(F.greatest(p + d, F.lit(0.0)), F.lit(255.0)))


def dimmed_line(pixels: Column, level: int, h: int, w: int) -> Column:
    """A flat image whose middle row is dimmed to the ratio of a level (0 to 6)."""
    first = h // 2 * w
    return F.transform(pixels, lambda p, i: F.when((i >= first) & (i < first + w), p * RATIOS[level]).otherwise(p))
