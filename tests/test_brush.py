"""Batches of images under sets of shapes: against drawing them one by one, and in time for many images."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import brush
from seamline.functions import generators as G
from seamline.functions import shapes as S


def images(spark, n: int, side: int):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.pmod(i * 7 + F.col("id") * 3, F.lit(251)).cast("double"))
    return spark.range(n).repartition(8).select("id", F.col("id").cast("string").alias("key"), pixels.alias("pixels"))


def test_changes_are_those_of_painted_images(spark):
    kinds = [G.subtle(k, 2, F.col("key"), 24, 24, 1 / 8) for k in G.SUBTLE] + [G.placed(k, F.col("key"), F.col("pixels"), 24, 24, 1 / 8) for k in ("spot", "crack")] + [F.array().cast(f"array<{S.SHAPE}>")]
    given = images(spark, 30, 24).select("id", "pixels", F.array(*kinds).alias("sets"))
    got = {(r.id, r["at"]): (r.n, r["sum"]) for r in given.mapInArrow(brush.changes(24), "id long, at int, n int, sum double").collect()}
    each = given.select("id", "pixels", F.posexplode("sets").alias("at", "s")).select("id", "pixels", "at", S.painted(F.col("pixels"), 24, F.col("s")).alias("p")).collect()
    assert len(got) == len(each) == 30 * len(kinds)
    for r in each:
        away = np.abs(np.array(r.p) - np.array(r.pixels))
        assert got[r.id, r["at"]] == (int((away > 0.01).sum()), pytest.approx(away.sum()))


def test_many_images(spark):
    """60,000 drawn images: pixel by pixel through the expressions of a shape this took minutes."""
    kinds = [G.subtle(k, n, F.col("key"), 32, 32, 1 / 8) for k in G.SUBTLE for n in G.LEVELS]
    began = time.time()
    found = images(spark, 2000, 32).select("id", "pixels", F.array(*kinds).alias("sets")).mapInArrow(brush.changes(32), "id long, at int, n int, sum double")
    assert found.count() == 60_000
    assert time.time() - began < 25


def test_line_takes_the_mean_about_it(spark):
    """Lots are drawn once an image: the mean of the level's line equals the one of the pixels about its place."""
    rows = images(spark, 20, 32).select("id", "key", "pixels", G.ratio_line(3, F.col("key"), F.col("pixels"), 32, 32, 1 / 8).alias("s"), G.between(F.col("key"), "line/cx", 5, 27).alias("cx"), G.between(F.col("key"), "line/cy", 5, 27).alias("cy"))
    for r in rows.collect():
        half = (r.s[0].by - r.s[0].ay) / 2
        about = np.array(r.pixels).reshape(32, 32)[max(0, int(r.cy - half)) : int(r.cy + half), max(0, r.cx - 2) : r.cx + 2]
        assert r.s[0].amount == np.floor(about.mean() * 0.5)
