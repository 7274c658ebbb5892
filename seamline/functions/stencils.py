"""Neighbourhood measures of flat images by index arithmetic: binary patterns, gradients, deviations at several scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .matrices import let

#: Neighbours of a pixel by bit (fixed order): rows and columns away.
RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


def inner(pixels: Column, width: int, f) -> Column:
    """f(at) for each pixel that has all neighbours, where at(dy, dx) is the value so far away."""

    def each(p: Column) -> Column:
        rows = (F.size(p) / width).cast("int")
        place = lambda k: (F.floor(k / (width - 2)) + 1).cast("int") * width + F.pmod(k, F.lit(width - 2)) + 1
        values = F.transform(F.sequence(F.lit(0), (rows - 2) * (width - 2) - 1), lambda k: let(place(k), lambda i: f(lambda dy, dx: F.get(p, i + (dy * width + dx)))))
        return F.when(rows > 2, values)

    return let(pixels, each)


def mean(values: Column) -> Column:
    return let(values, lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))


def deviation(values: Column) -> Column:
    """Standard deviation of an array, of all its values."""
    return let(values, lambda v: let(mean(v), lambda m: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v))))


def lbp(pixels: Column, width: int) -> Column:
    """Local binary pattern of each inner pixel: a bit for each neighbour that is no darker."""
    bit = lambda at, k: F.when(at(*RING[k]) >= at(0, 0), 1 << k).otherwise(0)
    return inner(pixels, width, lambda at: sum((bit(at, k) for k in range(1, 8)), bit(at, 0)))


def histogram(codes: Column, bins: int = 256) -> Column:
    """Counts of the whole numbers 0 to bins - 1: equal ones stand together once sorted, so that one pass counts them."""
    runs = lambda c: F.aggregate(F.array_sort(c), F.array().cast("array<struct<k:int,n:int>>"), _count)
    pad = lambda r: F.aggregate(r, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array_repeat(F.lit(0), x["k"] - F.size(acc)), F.array(x["n"])))
    return let(let(codes, runs), lambda r: let(pad(r), lambda h: F.concat(h, F.array_repeat(F.lit(0), F.lit(bins) - F.size(h)))))


def _count(acc: Column, x: Column) -> Column:
    last = F.get(acc, F.size(acc) - 1)
    same = (F.size(acc) > 0) & (last["k"] == x)
    one = lambda n: F.array(F.struct(x.cast("int").alias("k"), n.cast("int").alias("n")))
    return F.when(same, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), one(last["n"] + 1))).otherwise(F.concat(acc, one(F.lit(1)))).cast("array<struct<k:int,n:int>>")


def chi_square(a: Column, b: Column) -> Column:
    """Half the sum of (a - b)^2 / (a + b) over the shares of two histograms; empty bins add nothing."""
    share = lambda h: let(F.aggregate(h, F.lit(0), lambda s, x: s + x), lambda n: F.transform(h, lambda x: x / n))
    term = lambda x, y: F.when(x + y > 0, (x - y) * (x - y) / (x + y)).otherwise(0.0)
    return F.aggregate(F.zip_with(share(a), share(b), term), F.lit(0.0), lambda s, x: s + x) / 2


def gradients(pixels: Column, width: int) -> Column:
    """Sobel magnitude of each inner pixel."""
    across = lambda at: at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
    down = lambda at: at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
    return inner(pixels, width, lambda at: F.hypot(across(at), down(at)))


def shrunk(pixels: Column, width: int, k: int) -> Column:
    """Means of whole blocks of k by k pixels."""
    if k == 1:
        return pixels
    cols = width // k

    def each(p: Column) -> Column:
        blocks = F.sequence(F.lit(0), (F.size(p) / width / k).cast("int") * cols - 1)
        first = lambda b: (F.floor(b / cols).cast("int") * width + F.pmod(b, F.lit(cols))) * k
        total = lambda i: sum((F.get(p, i + (y * width + x)) for y in range(k) for x in range(k) if y or x), F.get(p, i))
        return F.transform(blocks, lambda b: let(first(b), lambda i: total(i) / (k * k)))

    return let(pixels, each)


def deviation_by_scale(pixels: Column, width: int, scales=(1, 2, 4)) -> Column:
    """Mean deviation over an image and its block means."""
    each = [deviation(shrunk(pixels, width, k)) for k in scales]
    return sum(each[1:], each[0]) / len(each)


def worst_scale(a: Column, b: Column, width: int, scales=(1, 2, 4), percent: int = 5) -> Column:
    """Greatest over scales of the mean of the largest ``percent`` of differences between two images (one at least)."""

    def at(k: int) -> Column:
        away = F.zip_with(shrunk(a, width, k), shrunk(b, width, k), lambda x, y: F.abs(x - y))
        top = lambda d: F.slice(F.sort_array(d, asc=False), F.lit(1), F.greatest(F.floor(F.size(d) * percent / 100).cast("int"), F.lit(1)))
        return mean(let(away, top))

    return F.greatest(*map(at, scales))
