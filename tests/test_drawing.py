"""Drawn shapes against NumPy, generators' lots, and shapes over tiles against the whole image."""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import generators as G
from seamline.functions import shapes as S
from seamline.operators import drawing

FIELDS = [x.split(":")[0] for x in S.SHAPE.removeprefix("struct<").removesuffix(">").split(",")]


def brute(image, shapes):
    """Shapes (dicts of FIELDS) on a float image, one after another."""
    out = image.astype(float).copy()
    y, x = np.mgrid[: image.shape[0], : image.shape[1]].astype(float)
    for s in shapes:
        ax, ay, bx, by, r, r2 = (s[k] for k in ("ax", "ay", "bx", "by", "r", "r2"))
        d = np.hypot(x - ax, y - ay)
        if s["form"] == S.LINE:
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = np.clip(((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n, 0, 1) if n else 0
            c = np.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)) ** 2 <= r * r + 1e-9
        elif s["form"] == S.DISC:
            c = d**2 <= r * r + 1e-9
        elif s["form"] == S.ELLIPSE:
            a = np.radians(s["turn"])
            c = (((x - ax) * np.cos(a) + (y - ay) * np.sin(a)) / r) ** 2 + (((y - ay) * np.cos(a) - (x - ax) * np.sin(a)) / r2) ** 2 <= 1 + 1e-9
        elif s["form"] == S.BOX:
            c = (x >= ax) & (x <= bx) & (y >= ay) & (y <= by)
        elif s["form"] == S.FADE:
            c = np.exp(-(d**2) / (2 * r * r))
        elif s["form"] == S.SOFT:
            c = np.clip((r + r2 - d) / (2 * r2), 0, 1)
        elif s["form"] == S.SHADOW:
            c = np.exp(-(d**2) / (2 * r * r)) * (x - ax) / r
        elif s["form"] == S.CHIP:
            c = x + y <= r
        else:
            raise NotImplementedError
        out = out + s["amount"] * c if s["mode"] == S.ADD else out + s["alpha"] * c * (s["amount"] - out)
    return np.clip(out, 0, 255)


CASES = [
    [(S.LINE, dict(ax=2, ay=3, bx=25, by=17, r=1.5, amount=30))],
    [(S.LINE, dict(ax=5, ay=5, bx=5, by=5, r=2, amount=200, mode=S.ADD))],
    [(S.DISC, dict(ax=10, ay=8, r=5, amount=25)), (S.LINE, dict(ax=0, ay=8, bx=30, by=8, r=0.5, amount=250, alpha=0.5))],
    [(S.ELLIPSE, dict(ax=12, ay=9, r=8, r2=3, turn=30, amount=40, alpha=0.3))],
    [(S.FADE, dict(ax=9, ay=9, r=4, amount=-40, mode=S.ADD)), (S.SHADOW, dict(ax=20, ay=9, r=3, amount=25, mode=S.ADD))],
    [(S.SOFT, dict(ax=-3, ay=9, r=8, r2=2, amount=90, mode=S.ADD)), (S.BOX, dict(ax=3, ay=4, bx=9, by=11, amount=-60, mode=S.ADD))],
    [(S.CHIP, dict(r=6, amount=10)), (S.DISC, dict(ax=40, ay=40, r=3, amount=0))],
    [],
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_painted_against_numpy(spark, case):
    rng = np.random.default_rng(case)
    image = rng.integers(0, 256, (20, 31)).astype(float)
    shapes = F.array(*[S.shape(form, **k) for form, k in CASES[case]]).cast(f"array<{S.SHAPE}>")
    rows = spark.createDataFrame([(image.ravel().tolist(),)], "pixels array<double>")
    got = np.array(rows.select(S.painted(F.col("pixels"), 31, shapes).alias("p")).first().p).reshape(20, 31)
    base = dict.fromkeys(FIELDS, 0.0) | {"mode": S.SET, "alpha": 1.0}
    assert np.allclose(got, brute(image, [base | k | {"form": form} for form, k in CASES[case]]))


def test_tiles_together_are_the_drawn_image(spark):
    """Shapes that cross tile borders, on tiles met by a join, equal the shapes on the whole image."""
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (48, 64)).astype(float)
    size, rows, cols = 16, 3, 4
    tiles = spark.createDataFrame([(1, ty, tx, image[ty * 16 : ty * 16 + 16, tx * 16 : tx * 16 + 16].ravel().tolist()) for ty in range(rows) for tx in range(cols)], "image int, ty int, tx int, pixels array<double>")
    whole = spark.createDataFrame([(1, image.ravel().tolist())], "image int, pixels array<double>")
    for kind in G.WHOLE:
        shapes = G.whole(kind, F.lit("1"), 48, 64, 1 / 8)
        want = np.array(whole.select(S.painted(F.col("pixels"), 64, shapes).alias("p")).first().p).reshape(48, 64)
        given = whole.select("image", F.posexplode(shapes).alias("n", "shape"))
        got = np.zeros_like(image)
        for r in drawing.drawn(tiles, given, ["image"], size, rows, cols).collect():
            got[r.ty * 16 : r.ty * 16 + 16, r.tx * 16 : r.tx * 16 + 16] = np.reshape(r.painted, (16, 16))
        assert np.allclose(got, want) and (want != image).any()
        reached = drawing.touched(given, ["image"], size, rows, cols)
        assert reached.select("ty", "tx").distinct().count() <= rows * cols
    line = whole.select("image", F.lit(0).alias("n"), S.shape(S.LINE, 0, 0, 63, 47, r=0.5, amount=0).alias("shape"))
    assert drawing.touched(line, ["image"], size, rows, cols).count() < rows * cols


def test_places_are_drawn_by_key(spark):
    keys = spark.createDataFrame([(f"k{i}", [100.0] * 256 * 256) for i in range(40)], "key string, pixels array<double>")
    for kind in G.PLACED:
        found = keys.select("key", G.placed(kind, F.col("key"), F.col("pixels"), 256, 256).alias("s")).collect()
        assert len({(r.s[0].ax, r.s[0].ay) for r in found}) > 20
        assert all(0 <= v <= 256 for r in found for s in r.s for v in (s.ax, s.ay))
        tones = {s.amount for r in found for s in r.s}
        assert len(tones) == 2  # both signs
    want = {k: int(hashlib.md5(f"{k}/spot/cx".encode()).hexdigest()[:8], 16) % 176 + 40 for k in ("k0", "k7")}
    got = {r.key: r.s[0].ax for r in keys.select("key", G.placed("spot", F.col("key"), F.col("pixels"), 256, 256).alias("s")).collect()}
    assert all(got[k] == want[k] for k in want)


def test_sizes_of_use(spark):
    """Tiles of 128 by 128."""
    images = spark.range(64).repartition(8).select("id", F.transform(F.sequence(F.lit(0), F.lit(128 * 128 - 1)), lambda i: F.pmod(i * 7 + F.col("id"), F.lit(256)).cast("double")).alias("pixels"))
    began = time.time()
    drawn = images.select(S.painted(F.col("pixels"), 128, G.placed("scratch", F.col("id").cast("string"), F.col("pixels"), 128, 128, 0.5)).alias("p"))
    assert drawn.select(F.sum(F.aggregate("p", F.lit(0.0), lambda a, b: a + b))).first()[0] > 0
    assert time.time() - began < 30


def test_levels_grow(spark):
    made = {f"{k} {n}": G.subtle(k, n, F.lit("a"), 64, 64, 0.25) for k in G.SUBTLE for n in (1, 3)} | {f"{k}_tile {n}": G.subtle_tile(k, n, 64, 64, 0.25) for k in G.SUBTLE_TILE for n in (1, 3)}
    shapes = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), s.alias("s")) for k, s in made.items()])).alias("d"))
    grey = F.array_repeat(F.lit(128.0), 64 * 64)
    change = {r.k: r.c for r in shapes.select("d.k", F.aggregate(S.painted(grey, 64, F.col("d.s")), F.lit(0.0), lambda a, b: a + F.abs(b - 128)).alias("c")).collect()}
    assert all(0 < change[f"{k} 1"] < change[f"{k} 3"] for k in [*G.SUBTLE, *(f"{k}_tile" for k in G.SUBTLE_TILE)])
