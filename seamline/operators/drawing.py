"""Shapes on images that are stored as tiles: a shape meets the tiles that it reaches by a join on grid places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions import shapes as S


def touched(shapes: DataFrame, keys: list[str], size: int, rows: int, cols: int) -> DataFrame:
    """``shapes`` (keys, shape and more) with ty and tx: each shape once for each tile of ``size`` pixels that it may reach.

    Tiles come from the shape's box; of lines, those further away than their half diagonal are left out.
    """
    box = shapes.withColumn("_box", S.reach(F.col("shape")))
    span = lambda a, b, n: F.sequence(F.greatest(F.floor(F.col(f"_box.{a}") / size), F.lit(0)).cast("int"), F.least(F.floor(F.col(f"_box.{b}") / size), F.lit(n - 1)).cast("int"))
    within = box.where((F.col("_box.x1") >= 0) & (F.col("_box.y1") >= 0) & (F.col("_box.x0") < cols * size) & (F.col("_box.y0") < rows * size))
    at = within.withColumn("ty", F.explode(span("y0", "y1", rows))).withColumn("tx", F.explode(span("x0", "x1", cols)))
    half, s = size / 2, F.col("shape")
    middle = lambda t: F.col(t) * size + half - 0.5
    near = S.near(s, middle("tx"), middle("ty")) <= (s["r"] + half * 1.5) * (s["r"] + half * 1.5)
    return at.where((s["form"] != S.LINE) | near).drop("_box")


def drawn(tiles: DataFrame, shapes: DataFrame, keys: list[str], size: int, rows: int, cols: int) -> DataFrame:
    """``tiles`` (keys, ty, tx, pixels) with column painted: its pixels under the shapes (keys, n, shape) of its image, in the order of n.

    Tiles that no shape reaches stay as they are. A tile's shapes meet in one row; an image's tiles never do.
    """
    own = touched(shapes, keys, size, rows, cols).groupBy(*keys, "ty", "tx").agg(F.array_sort(F.collect_list(F.struct("n", "shape"))).alias("_s"))
    both = tiles.join(own, [*keys, "ty", "tx"], "left").withColumn("_here", F.coalesce(F.transform("_s", lambda s: s["shape"]), F.array().cast(f"array<{S.SHAPE}>")))
    return both.withColumn("painted", S.painted(F.col("pixels"), size, F.col("_here"), F.col("tx") * size, F.col("ty") * size)).drop("_s", "_here")
