"""Shapes drawn on batches of flat images by NumPy, within the tasks that hold the images.

What a shape covers depends on its geometry alone: each is worked out once a worker, within its box, and kept for the images that share it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Covers that a worker keeps, of images of so many pixels at most (16 bytes each): 128 MB at most.
KEPT, KEPT_PIXELS = 8192, 1024
#: What a shape does: add amount times cover, or move towards amount by alpha times cover.
ADD, SET = 1, 2
#: Added where a length is compared, so that equal ones are within.
EPS = 1e-9
#: Forms. LINE: within r of the segment a to b. DISC: within r of a. ELLIPSE: half axes r and r2, turned. BOX: a to b. FADE: Gaussian of spread r. SOFT: disc whose edge
#: falls from 1 to 0 over r - r2 to r + r2. SHADOW: FADE times the distance to the right over r. STRIPES: every fourth row from ay - r up to ay + r, half in the next. GRAIN: noise in a box, r its seed.
#: WAVE: sine rows of amplitude r, r2 apart. CHIP: corner triangle of side r. SEAM: sine column about ax, ay - r to ay + r.
LINE, DISC, ELLIPSE, BOX, FADE, SOFT, SHADOW, STRIPES, GRAIN, WAVE, CHIP, SEAM = range(1, 13)


def reach(form: int, ax: float, ay: float, bx: float, by: float, r: float, r2: float) -> tuple[float, float, float, float]:
    """x0, y0, x1, y1 as by ``shapes.reach``."""
    if form in (WAVE, STRIPES):
        return -1e9, -1e9, 1e9, 1e9
    if form == CHIP:
        return 0.0, 0.0, r, r
    if form in (LINE, BOX, GRAIN):
        pad = r if form == LINE else 0.0
        return min(ax, bx) - pad, min(ay, by) - pad, max(ax, bx) + pad, max(ay, by) + pad
    far = 9 * r if form in (FADE, SHADOW) else max(r, r2) if form == ELLIPSE else max(r, 6.0) if form == SEAM else r + r2
    return ax - far, ay - far, ax + far, ay + far


def _line(x, y, ax, ay, bx, by, r, r2, turn):
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    along = np.minimum(np.maximum(((x - ax) * dx + (y - ay) * dy) / length, 0.0), 1.0) if length > 0 else 0.0
    away = (x - (ax + along * dx)) ** 2 + (y - (ay + along * dy)) ** 2
    return (x >= min(ax, bx) - r - EPS) & (x <= max(ax, bx) + r + EPS) & (away <= r * r + EPS)


def _within(x, y, ax, ay, far):
    return (np.abs(x - ax) <= far + EPS) & (np.abs(y - ay) <= far + EPS)


def _disc(x, y, ax, ay, bx, by, r, r2, turn):
    return _within(x, y, ax, ay, r) & ((x - ax) ** 2 + (y - ay) ** 2 <= r * r + EPS)


def _ellipse(x, y, ax, ay, bx, by, r, r2, turn):
    dx, dy, a = x - ax, y - ay, math.radians(turn)
    u, v = (dx * math.cos(a) + dy * math.sin(a)) / r, (dy * math.cos(a) - dx * math.sin(a)) / r2
    return _within(x, y, ax, ay, max(r, r2)) & (u * u + v * v <= 1 + EPS)


def _box(x, y, ax, ay, bx, by, r, r2, turn):
    return (x >= ax - EPS) & (x <= bx + EPS) & (y >= ay - EPS) & (y <= by + EPS)


def _fade(x, y, ax, ay, bx, by, r, r2, turn):
    return np.exp(-((x - ax) ** 2 + (y - ay) ** 2) / (2 * r * r))


def _soft(x, y, ax, ay, bx, by, r, r2, turn):
    d2 = (x - ax) ** 2 + (y - ay) ** 2
    return np.minimum(np.maximum((r + r2 - np.sqrt(d2)) / (2 * r2), 0.0), 1.0) if r2 > 0 else d2 <= r * r + EPS


def _shadow(x, y, ax, ay, bx, by, r, r2, turn):
    return _fade(x, y, ax, ay, bx, by, r, r2, turn) * (x - ax) / r


def _stripes(x, y, ax, ay, bx, by, r, r2, turn):
    row = np.floor(y - (ay - r) + EPS)
    tone = np.where(row % 4 == 0, 1.0, np.where(row % 4 == 1, 0.5, 0.0))
    return np.where((row < 0) | (y >= ay + r - EPS), 0.0, tone) + 0 * x


def _grain(x, y, ax, ay, bx, by, r, r2, turn):
    mixed = (x.astype(np.int64) * 7919 + y.astype(np.int64) * 104_729 + int(r) * 1_299_709) * 15_485_863 % 65_537
    return np.where(_box(x, y, ax, ay, bx, by, r, r2, turn), mixed / 32_768 - 1, 0.0)


def _wave(x, y, ax, ay, bx, by, r, r2, turn):
    return np.abs((y - r * np.sin(x * 0.1)) % r2 - 0.5) <= 0.5 + EPS


def _chip(x, y, ax, ay, bx, by, r, r2, turn):
    return x + y <= r + EPS


def _seam(x, y, ax, ay, bx, by, r, r2, turn):
    return (np.abs(y - ay) <= r + EPS) & (np.abs(x - ax - 5 * np.sin((y - ay) * 0.5)) <= 0.5 + EPS)


#: How much of the pixels at x (a row) and y (a column) a shape takes, by form.
COVER: dict[int, Callable] = {LINE: _line, DISC: _disc, ELLIPSE: _ellipse, BOX: _box, FADE: _fade, SOFT: _soft, SHADOW: _shadow, STRIPES: _stripes, GRAIN: _grain, WAVE: _wave, CHIP: _chip, SEAM: _seam}


def _covered(width: int, height: int, left: int, top: int, form: int, *lengths: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a flat image that a shape covers, and how much of them. ``lengths``: ax to turn."""
    if form not in COVER:
        return np.empty(0, np.int64), np.empty(0)
    x0, y0, x1, y1 = reach(form, *lengths[:6])
    x = np.arange(max(math.ceil(x0 - EPS), left), min(math.floor(x1 + EPS), left + width - 1) + 1, dtype=float)[None]
    y = np.arange(max(math.ceil(y0 - EPS), top), min(math.floor(y1 + EPS), top + height - 1) + 1, dtype=float)[:, None]
    if not x.size or not y.size:
        return np.empty(0, np.int64), np.empty(0)
    with np.errstate(divide="raise", invalid="raise"):
        cover = np.broadcast_to(COVER[form](x, y, *lengths), (y.size, x.size)).astype(float)
    rows, cols = np.nonzero(cover)
    return (rows + int(y[0, 0]) - top) * width + cols + int(x[0, 0]) - left, cover[rows, cols]


_kept = lru_cache(KEPT)(_covered)


def paint(image: np.ndarray, width: int, shapes: list[tuple], left: int = 0, top: int = 0) -> np.ndarray:
    """A flat image under shapes (tuples of the fields of ``shapes.SHAPE``) in turn, within 0 to 255; as it is without shapes."""
    if not shapes:
        return image
    out, height = image.copy(), len(image) // width
    find = _kept if len(image) <= KEPT_PIXELS else _covered
    for form, *lengths, mode, amount, alpha in shapes:
        at, cover = find(width, height, left, top, form, *lengths)
        old = out[at]
        out[at] = old + amount * cover if mode == ADD else old + alpha * cover * (amount - old)
    return np.minimum(np.maximum(out, 0.0, out=out), 255.0, out=out)


def _parts(lists: pa.ListArray) -> np.ndarray:
    """Where the lists of a column start and end in their values."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(float, copy=False)


def _tuples(shapes: pa.StructArray) -> list[tuple]:
    return list(zip(*[f.to_numpy(zero_copy_only=False).tolist() for f in shapes.flatten()], strict=True))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def painted(pixels: pa.Array, shapes: pa.Array, width: pa.Array, left: pa.Array, top: pa.Array) -> pa.Array:
    """Each row's image under its shapes."""
    values, ends, listed, of = _numbers(pixels.flatten()), _parts(pixels), _tuples(shapes.flatten()), _parts(shapes)
    at = zip(width.to_pylist(), left.to_pylist(), top.to_pylist(), strict=True)
    out = [paint(values[ends[i] : ends[i + 1]], w, listed[of[i] : of[i + 1]], x, y) for i, (w, x, y) in enumerate(at)]
    starts = pa.array(ends, pa.int32(), mask=np.append(pixels.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(starts, np.concatenate([*out, np.empty(0)]))


def changes(width: int) -> Callable:
    """For mapInArrow: batches of id, pixels and sets of shapes to id, at (the set's place), n and sum.

    n counts the pixels that a set changes by over 0.01, sum adds all changes in the pixels' order.
    """

    def measure(batches):
        for batch in batches:
            ids, pixels, sets = batch.columns
            values, ends, per_row = _numbers(pixels.flatten()), _parts(pixels), _parts(sets)
            inner = sets.flatten()
            listed, of = _tuples(inner.flatten()), _parts(inner)
            n, total, row = np.zeros(len(inner), np.int32), np.zeros(len(inner)), np.repeat(np.arange(len(ids)), np.diff(per_row))
            for k, i in enumerate(row.tolist()):
                image = values[ends[i] : ends[i + 1]]
                away = np.abs(paint(image, width, listed[of[k] : of[k + 1]]) - image)
                n[k], total[k] = np.count_nonzero(away > 0.01), np.cumsum(away)[-1] if len(away) else 0.0
            at = np.arange(len(inner), dtype=np.int32) - per_row[row].astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(at), pa.array(n), pa.array(total)], ["id", "at", "n", "sum"])

    return measure
