"""Shapes drawn on images of any size.

A shape is a struct; pixels take each shape of an array in turn. Coordinates are those of pixel centres, x to the right
and y down, from 0. ``brush.COVER`` says how much of a pixel a shape takes (0 to 1; shadows and grain also below 0).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import brush
from .brush import ADD, BOX, CHIP, DISC, ELLIPSE, FADE, GRAIN, LINE, SEAM, SET, SHADOW, SOFT, STRIPES, WAVE  # noqa: F401

#: form, two points, two lengths, a turn in degrees, what it does, by how much, and how densely.
SHAPE = "struct<form:int,ax:double,ay:double,bx:double,by:double,r:double,r2:double,turn:double,mode:int,amount:double,alpha:double>"


def shape(form: int, ax=0.0, ay=0.0, bx=0.0, by=0.0, r=0.0, r2=0.0, turn=0.0, mode: int = SET, amount=0.0, alpha=1.0) -> Column:
    """A shape of numbers or columns."""
    column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    values = [F.lit(form), *map(column, (ax, ay, bx, by, r, r2, turn)), F.lit(mode), column(amount), column(alpha)]
    names = [x.split(":")[0] for x in SHAPE.removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)]).cast(SHAPE)


def near(s: Column, x: Column, y: Column) -> Column:
    """Squared distance of a place from the segment a to b."""
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    length = dx * dx + dy * dy
    along = F.when(length > 0, F.least(F.greatest(((x - s["ax"]) * dx + (y - s["ay"]) * dy) / length, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    away = lambda p, a, d: (p - (a + along * d)) * (p - (a + along * d))
    return away(x, s["ax"], dx) + away(y, s["ay"], dy)


def painted(pixels: Column, width: int, shapes: Column, left: int | Column = 0, top: int | Column = 0) -> Column:
    """A flat image with shapes drawn on it in turn, within 0 to 255. ``left`` and ``top``: where it lies in the shapes' coordinates.

    Drawn by NumPy on batches of images: expressions took a pixel through all of a shape's terms, one pixel at a time.
    """
    left, top = (F.lit(v) if isinstance(v, int) else v for v in (left, top))
    return brush.painted(pixels, shapes, F.lit(width), left, top)


def reach(s: Column) -> Column:
    """struct<x0, y0, x1, y1>: where a shape's cover may be other than 0 (fades: 9 spreads, beyond which it is below 1e-17)."""
    far = F.when(s["form"].isin(FADE, SHADOW), 9 * s["r"]).when(s["form"] == ELLIPSE, F.greatest(s["r"], s["r2"])).when(s["form"] == SEAM, F.greatest(s["r"], F.lit(6.0))).otherwise(s["r"] + s["r2"])
    both = s["form"].isin(LINE, BOX, GRAIN)
    pad = F.when(s["form"] == LINE, s["r"]).when(both, 0.0).otherwise(far)
    everywhere = s["form"].isin(WAVE, STRIPES)
    low = lambda a, b: F.when(everywhere, F.lit(-1e9)).when(s["form"] == CHIP, 0.0).when(both, F.least(s[a], s[b]) - pad).otherwise(s[a] - pad)
    high = lambda a, b: F.when(everywhere, F.lit(1e9)).when(s["form"] == CHIP, s["r"]).when(both, F.greatest(s[a], s[b]) + pad).otherwise(s[a] + pad)
    return F.struct(low("ax", "bx").alias("x0"), low("ay", "by").alias("y0"), high("ax", "bx").alias("x1"), high("ay", "by").alias("y1"))


def polyline(points: Iterable[tuple], width: float, **what) -> list[Column]:
    """Segments of a line through points."""
    points = list(points)
    return [shape(LINE, *a, *b, r=width / 2, **what) for a, b in zip(points[:-1], points[1:], strict=True)]
