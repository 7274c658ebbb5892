"""Synthetic defects as shapes: what to draw for a kind, a level, an image's size and, where drawn by lot, its key.

Lengths are the fixed ones of tiles of 256 (``unit`` scales them to other sizes); places relative to the image need none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import shapes as S
from .matrices import let

#: Fixed values. Kinds drawn by lot: form, radius or width, change of brightness, and blur or number.
PLACED = {
    "spot": ("disc", 5, 30, 0),
    "big_spot": ("disc", 10, 30, 0),
    "stain": ("disc", 15, 25, 7),
    "scratch": ("line", 1, 30, 1),
    "crack": ("zigzag", 1, 25, 1),
    "multi_scratch": ("line", 1, 25, 3),
    "faint_spot": ("disc", 5, 10, 0),
    "thin_scratch": ("line", 1, 15, 1),
    "gradient_stain": ("gradient", 30, 16, 10),
}
#: Subtle kinds at three levels, kinds of whole images, of tiles, and subtle ones of a second list.
SUBTLE = ["hair_scratch", "faint_spot", "micro_crack", "gradient_stain", "roughness", "discoloration", "pinhole", "dent_shadow", "oxide_edge", "rolling_mark"]
WHOLE = ["scratch_long", "spot_cluster", "crack_zigzag", "stain_large", "multi_scratch"]
TILE = ["scratch", "thick_scratch", "bright_line", "spot", "big_spot", "crack", "stain", "multi_scratch"]
SUBTLE_TILE = ["faint_scratch", "micro_spot", "slight_stain", "hairline_crack", "tiny_pit", "surface_wave", "light_scuff", "dim_spot", "thin_line", "edge_chip"]
LEVELS = [1, 2, 3]
#: Brightness of a drawn line over that of its surroundings, by level; level 0 has no line.
RATIOS = {0: None, 1: 0.0, 2: 0.25, 3: 0.5, 4: 0.75, 5: 0.9, 6: 0.95}


def lot(key: Column, what: str, n: int | Column) -> Column:
    """A whole number from 0 to n - 1 by the md5 of a key and what it is for."""
    number = lambda w: F.conv(F.substring(F.md5(F.concat(key, w).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.pmod(let(F.lit(f"/{what}"), number), F.lit(n) if isinstance(n, int) else n)


def between(key: Column, what: str, low: int, high: int) -> Column:
    """A whole number from low to high - 1, low if there is none."""
    return lot(key, what, max(1, high - low)) + low


def placed(kind: str, key: Column, pixels: Column, h: int, w: int, unit: float = 1.0) -> Column:
    """array<SHAPE> of a kind of PLACED: place, direction and sign by lot of the key; lines take the brightness at the place drawn."""
    form, size, change, more = PLACED[kind]
    n = lambda x: max(1, round(x * unit))
    at = lambda what, a, b: between(key, f"{kind}/{what}", a, b)
    cx, cy = at("cx", n(40), w - n(40)), at("cy", n(40), h - n(40))
    by = (1 - 2 * lot(key, f"{kind}/sign", 2)) * float(change)
    if form == "disc":
        return F.array(S.shape(S.SOFT if more else S.DISC, cx.cast("double"), cy.cast("double"), r=size * unit, r2=more * unit, mode=S.ADD, amount=by))
    if form == "gradient":
        return F.array(S.shape(S.SOFT, cx.cast("double"), cy.cast("double"), r=size * unit, r2=more * unit * 3, mode=S.ADD, amount=by))
    tone = F.least(F.greatest(F.floor(F.get(pixels, (cy * w + cx).cast("int"))) + by, F.lit(0.0)), F.lit(255.0))
    out = []
    for k in range(more):
        if form == "zigzag":
            x, y = at("x", n(20), w - n(20)), at("y", n(20), n(40))
            points = [(x, y)]
            for i in range(5):
                x = F.least(F.greatest(x + at(f"dx{i}", -n(15), n(15)), F.lit(n(5))), F.lit(w - n(5)))
                y = F.least(y + at(f"dy{i}", n(20), n(40)), F.lit(h - n(5)))
                points.append((x, y))
            out += S.polyline([(x.cast("double"), y.cast("double")) for x, y in points], size, amount=tone)
            continue
        upright = lot(key, f"{kind}/way{k}", 2) == 0
        x, y, slant = at(f"x{k}", n(30), w - n(30)), at(f"y{k}", n(30), h - n(30)), at(f"slant{k}", -n(10), n(10))
        pick = lambda a, b, upright=upright: F.when(upright, a).otherwise(b).cast("double")
        out.append(S.shape(S.LINE, pick(x, F.lit(n(10))), pick(F.lit(n(10)), y), pick(x + slant, F.lit(w - n(10))), pick(F.lit(h - n(10)), y + slant), r=size / 2, amount=tone))
    return F.array(*out)


def subtle(kind: str, level: int, key: Column, h: int, w: int, unit: float = 1.0) -> Column:
    """array<SHAPE> of a kind of SUBTLE at level 1 to 3, about the middle; wandering and slanting by lot of the key."""
    cx, cy, m = w // 2, h // 2, float(level)
    dark = lambda form, amount, **k: F.array(S.shape(form, cx, cy, mode=S.ADD, amount=amount, **k))
    about = lambda side: {"bx": cx + side * unit / 2, "by": cy + side * unit / 2}
    square = lambda side, form, amount, **k: F.array(S.shape(form, cx - side * unit / 2, cy - side * unit / 2, **about(side), mode=S.ADD, amount=amount, **k))
    if kind == "hair_scratch":
        turn, half = F.radians(between(key, f"{kind}/{level}", 20, 71).cast("double")), int(min(w, h) * 0.6) / 2
        return F.array(S.shape(S.LINE, cx - half * F.cos(turn), cy - half * F.sin(turn), cx + half * F.cos(turn), cy + half * F.sin(turn), r=0.5, mode=S.ADD, amount=-5 * m))
    if kind == "micro_crack":
        length, y = (30 + 10 * level) * unit, F.lit(float(cy))
        points = [(F.lit(cx - length / 2), y)]
        for i in range(10):
            y = y + (lot(key, f"{kind}/{level}/{i}", 3) - 1) * max(1.0, 2 * unit)
            points.append((F.lit(cx - length / 2 + length * (i + 1) / 10), y))
        return F.array(*S.polyline(points, 1, mode=S.ADD, amount=-5 * m))
    return {
        "faint_spot": lambda: dark(S.DISC, -(3 * m + 2), r=(3 + level) * unit),
        "gradient_stain": lambda: dark(S.FADE, 5 * m, r=20 * unit),
        "roughness": lambda: square(40, S.GRAIN, 3 * m * math.sqrt(3), r=lot(key, f"{kind}/{level}", 1000).cast("double")),
        "discoloration": lambda: square(30, S.BOX, 2 * m + 2),
        "pinhole": lambda: dark(S.DISC, -10 * m, r=2 * unit),
        "dent_shadow": lambda: dark(S.SHADOW, 4 * m, r=15 * unit),
        "oxide_edge": lambda: dark(S.SEAM, -5 * m, r=30 * unit),
        "rolling_mark": lambda: dark(S.STRIPES, 2 * m + 1, r=20.0 if unit >= 1 else max(4.0, 20 * unit)),
    }[kind]()


def _zigzag(h: int, w: int, base: float, swing: float, first: float, step: float, n: int) -> list[tuple]:
    return [(int(w * (first + step * i)), int(h * (base + swing * (-1) ** i))) for i in range(n)]


def whole(kind: str, key: Column, h: int, w: int, unit: float = 1.0) -> Column:
    """array<SHAPE> of a kind of WHOLE, over a whole image; the cluster's spots by lot of the key."""
    if kind == "scratch_long":
        return F.array(S.shape(S.LINE, int(w * 0.1), int(h * 0.1), int(w * 0.9), int(h * 0.9), r=1.0, amount=30))
    if kind == "spot_cluster":
        spread = max(1, round(50 * unit))
        off = lambda k, axis: between(key, f"{kind}/{axis}{k}", -spread, spread + 1).cast("double")
        return F.array(*[S.shape(S.DISC, w // 2 + off(k, "x"), h // 2 + off(k, "y"), r=between(key, f"{kind}/r{k}", 5, 13) * unit, amount=25) for k in range(5)])
    if kind == "crack_zigzag":
        return F.array(*S.polyline(_zigzag(h, w, 0.3, 0.15, 0.1, 0.16, 6), 2, amount=25))
    if kind == "stain_large":
        return F.array(S.shape(S.ELLIPSE, w // 3, h // 2, r=80 * unit, r2=40 * unit, turn=15, amount=40))
    return F.array(*[S.shape(S.LINE, int(w * (0.2 + 0.15 * i)), int(h * 0.05), int(w * (0.2 + 0.15 * i)) + 10 * unit, int(h * 0.95), r=1.0, amount=30) for i in range(4)])


def tile(kind: str, h: int, w: int, unit: float = 1.0) -> Column:
    """array<SHAPE> of a kind of TILE: obvious defects at fixed places of a tile."""
    line = lambda a, b, c, d, width, tone: S.shape(S.LINE, int(w * a), int(h * b), int(w * c), int(h * d), r=width / 2, amount=tone)
    return {
        "scratch": lambda: F.array(line(0.1, 0.1, 0.9, 0.9, 2, 30)),
        "thick_scratch": lambda: F.array(line(0.2, 0.1, 0.8, 0.9, 4, 20)),
        "bright_line": lambda: F.array(line(0.15, 0.5, 0.85, 0.5, 3, 220)),
        "spot": lambda: F.array(S.shape(S.DISC, w // 2, h // 2, r=8 * unit, amount=25)),
        "big_spot": lambda: F.array(S.shape(S.DISC, w // 2, h // 2, r=15 * unit, amount=30)),
        "crack": lambda: F.array(*S.polyline(_zigzag(h, w, 0.4, 0.1, 0.1, 0.16, 6), 2, amount=25)),
        "stain": lambda: F.array(S.shape(S.ELLIPSE, w // 2, h // 2, r=18 * unit, r2=10 * unit, turn=30, amount=40)),
        "multi_scratch": lambda: F.array(*[S.shape(S.LINE, int(w * 0.15 * (i + 1)), 0, int(w * 0.15 * (i + 1)) + 5 * unit, h, r=1.0, amount=30) for i in range(3)]),
    }[kind]()


def subtle_tile(kind: str, level: int, h: int, w: int, unit: float = 1.0) -> Column:
    """array<SHAPE> of a kind of SUBTLE_TILE at level 1 (faintest) to 3."""
    delta, alpha, mid = 15 * level, level * 0.15, (w // 2, h // 2)
    return {
        "faint_scratch": lambda: F.array(S.shape(S.LINE, int(w * 0.2), int(h * 0.2), int(w * 0.8), int(h * 0.8), r=level / 2, amount=128 - delta)),
        "micro_spot": lambda: F.array(S.shape(S.DISC, *mid, r=(3 + level) * unit, amount=128 - delta)),
        "slight_stain": lambda: F.array(S.shape(S.ELLIPSE, *mid, r=(10 + 3 * level) * unit, r2=(6 + 2 * level) * unit, turn=45, amount=128 - delta, alpha=alpha)),
        "hairline_crack": lambda: F.array(*S.polyline(_zigzag(h, w, 0.45, 0.05, 0.2, 0.12, 5), 1, amount=128 - delta)),
        "tiny_pit": lambda: F.array(S.shape(S.DISC, w // 3, h // 3, r=(2 + level) * unit, amount=100 - delta)),
        "surface_wave": lambda: F.array(S.shape(S.WAVE, r=2 * level, r2=max(1, 20 - 5 * level), mode=S.ADD, amount=-(delta // 2))),
        "light_scuff": lambda: F.array(S.shape(S.BOX, w // 4, h // 4, 3 * w // 4, 3 * h // 4, amount=140 - delta, alpha=alpha / 2)),
        "dim_spot": lambda: F.array(S.shape(S.DISC, *mid, r=(5 + 2 * level) * unit, amount=120 - delta, alpha=alpha)),
        "thin_line": lambda: F.array(S.shape(S.LINE, 0, h // 2, w, h // 2, r=0.5, amount=128 - delta)),
        "edge_chip": lambda: F.array(S.shape(S.CHIP, r=5 * level * unit, amount=100 - delta)),
    }[kind]()


def ratio_line(level: int, key: Column, pixels: Column, h: int, w: int, unit: float = 1.0) -> Column:
    """array<SHAPE>: a steep line of 5 pixels whose brightness is the level's ratio of the mean about it; none at level 0."""
    if RATIOS[level] is None:
        return F.array().cast(f"array<{S.SHAPE}>")
    cx, cy = between(key, "line/cx", w // 6, w * 5 // 6 + 1), between(key, "line/cy", h // 6, h * 5 // 6 + 1)
    length, slant = between(key, "line/length", max(1, round(80 * unit)), round(250 * unit) + 1), between(key, "line/slant", -round(15 * unit), round(15 * unit) + 1)
    half, side = F.floor(length / 2), max(1, round(20 * unit))
    # lots are drawn once an image, not once a pixel
    inside = F.struct(F.greatest(cx - side, F.lit(0)).alias("x0"), F.least(cx + side, F.lit(w)).alias("x1"), F.greatest(cy - half, F.lit(0)).alias("y0"), F.least(cy + half, F.lit(h)).alias("y1"))
    row = lambda q, y: F.slice(pixels, (y * w + q["x0"] + 1).cast("int"), (q["x1"] - q["x0"]).cast("int"))
    about = let(inside, lambda q: F.flatten(F.transform(F.filter(F.sequence(q["y0"], q["y1"]), lambda y: y < q["y1"]), lambda y: row(q, y))))
    mean = let(about, lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a))
    lean = F.floor(slant / 2)
    return F.array(S.shape(S.LINE, (cx - lean).cast("double"), (cy - half).cast("double"), (cx + lean).cast("double"), (cy + half).cast("double"), r=2.5 * max(unit, 0.2), amount=F.floor(mean * RATIOS[level]).cast("double")))
