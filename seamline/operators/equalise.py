"""Contrast-limited adaptive histogram equalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.functions.matrices import let


def _clipped(hist: Column, area: int, limit: int) -> Column:
    """A histogram cut at ``limit``; what is over is spread evenly, and the rest over bins at equal steps."""
    over = F.aggregate(hist, F.lit(0), lambda a, x: a + F.greatest(x - limit, F.lit(0)))

    def spread(n: Column) -> Column:
        rest = F.pmod(n, F.lit(256))
        step = F.greatest(F.floor(256 / F.greatest(rest, F.lit(1))), F.lit(1))
        more = lambda i: F.when((F.pmod(i, step) == 0) & (F.floor(i / step) < rest), 1).otherwise(0)
        return F.transform(hist, lambda x, i: F.least(x, F.lit(limit)) + F.floor(n / 256).cast("int") + more(i))

    return let(over, spread)


def tables(images: DataFrame, width: int, height: int, rows: int, cols: int, clip: float) -> DataFrame:
    """id, tables: the lookup table of each tile of an image, in the order of tiles, from its clipped histogram.

    Pixels are counted by tile and value with map-side sums; a tile's 256 counts are one row, an image's tables too.
    """
    h, w = height // rows, width // cols
    area, limit = h * w, max(int(clip * h * w / 256), 1)
    places = images.select("id", F.posexplode("pixels").alias("pos", "v"))
    tile = (F.floor(F.col("pos") / width / h) * cols + F.floor(F.pmod(F.col("pos"), F.lit(width)) / w)).cast("int")
    counts = places.groupBy("id", tile.alias("tile"), F.col("v").cast("int").alias("v")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    listed = counts.groupBy("id", "tile").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("found"))
    fill = lambda acc, x: F.concat(acc, F.array_repeat(F.lit(0), x["v"] - F.size(acc)), F.array(x["n"]))
    hist = let(F.aggregate("found", F.array().cast("array<int>"), fill), lambda a: F.concat(a, F.array_repeat(F.lit(0), F.lit(256) - F.size(a))))
    running = lambda c: F.aggregate(c, F.array().cast("array<long>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + x)))
    table = F.transform(let(let(hist, lambda x: _clipped(x, area, limit)), running), lambda c: F.least(F.rint(c * (255.0 / area)), F.lit(255.0)))
    return listed.select("id", "tile", table.alias("table")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("tile", "table"))).alias("t")).select("id", F.transform("t", lambda x: x["table"]).alias("tables"))


def clahe(images: DataFrame, width: int, height: int, rows: int = 8, cols: int = 8, clip: float = 2.0) -> DataFrame:
    """id, pixels (id, flat grey values 0 to 255, height and width multiples of the grid) with contrast equalised by tile.

    A pixel is looked up in the tables of the four tiles whose middles are around it, and these are blended.
    """
    h, w = height // rows, width // cols
    both = images.select("id", "pixels").join(tables(images, width, height, rows, cols, clip), "id")
    down, right = lambda i: (F.floor(i / width)) / h - 0.5, lambda i: F.pmod(i, F.lit(width)) / w - 0.5
    inside = lambda x, n: F.greatest(F.least(x, F.lit(n - 1)), F.lit(0)).cast("int")
    at = lambda y, x, p: F.get(F.get(F.col("tables"), inside(y, rows) * cols + inside(x, cols)), p)

    def blended(s: Column, p: Column) -> Column:
        y, x = F.floor(s["y"]), F.floor(s["x"])
        fy, fx = s["y"] - y, s["x"] - x
        return F.rint((at(y, x, p) * (1 - fx) + at(y, x + 1, p) * fx) * (1 - fy) + (at(y + 1, x, p) * (1 - fx) + at(y + 1, x + 1, p) * fx) * fy)

    out = F.transform("pixels", lambda p, i: let(F.struct(down(i).alias("y"), right(i).alias("x")), lambda s: blended(s, p.cast("int"))))
    return both.select("id", out.alias("pixels"))
