"""Images as array<array<double>> columns, worked on by constant matrices: all expressions, no shuffle."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import dot


def lit(m: np.ndarray) -> Column:
    return F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m])


def let(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def rows_of(pixels: Column, width: int) -> Column:
    """The rows of a flat image."""
    return F.transform(F.sequence(F.lit(0), (F.size(pixels) / width).cast("int") - 1), lambda i: F.slice(pixels, i * width + 1, width))


def transposed(m: Column) -> Column:
    return let(m, lambda v: F.transform(F.sequence(F.lit(1), F.size(F.get(v, F.lit(0)))), lambda j: F.transform(v, lambda r: F.element_at(r, j))))


def times(m: Column, right: np.ndarray) -> Column:
    """Each row of m by each row of ``right``: m times right, transposed."""
    return F.transform(m, lambda row: F.transform(lit(right), lambda c: dot(row, c)))


def separable(m: Column, left: np.ndarray, right: np.ndarray) -> Column:
    """left * m * right transposed: resizing, smoothing, transforms, crops and mirrors are such products."""
    return transposed(times(transposed(times(m, right)), left))


def both(a: Column, b: Column, f) -> Column:
    """f of each pair of elements."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, f))


def flat(m: Column) -> Column:
    return F.flatten(m)


def top_mean(values: Column, k: int) -> Column:
    """Mean of the k greatest of an array."""
    return let(F.slice(F.sort_array(values, asc=False), 1, k), lambda top: F.aggregate(top, F.lit(0.0), lambda acc, x: acc + x) / F.size(top))


def bilinear(n: int, out: int) -> np.ndarray:
    """out by n: linear resizing with pixel centres aligned."""
    at = np.clip((np.arange(out) + 0.5) * n / out - 0.5, 0, n - 1)
    low = np.minimum(at.astype(int), n - 2) if n > 1 else np.zeros(out, int)
    m = np.zeros((out, n))
    m[np.arange(out), low] += 1 - (at - low)
    m[np.arange(out), np.minimum(low + 1, n - 1)] += at - low
    return m


def gaussian(n: int, sigma: float, radius: int) -> np.ndarray:
    """n by n: Gaussian smoothing; the border mirrors without repeating its edge."""
    k = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    k /= k.sum()
    m = np.zeros((n, n))
    for i in range(n):
        for d, w in zip(range(-radius, radius + 1), k, strict=True):
            j, period = i + d, max(1, 2 * (n - 1))
            j %= period
            m[i, j if j < n else period - j] += w
    return m


def dct(n: int) -> np.ndarray:
    """Orthonormal cosine transform."""
    k, x = np.mgrid[:n, :n]
    m = np.cos(np.pi * (x + 0.5) * k / n) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def waves(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts of the Fourier matrix."""
    k, x = np.mgrid[:n, :n]
    return np.cos(2 * np.pi * k * x / n), -np.sin(2 * np.pi * k * x / n)


def spectrum(m: Column, n: int) -> Column:
    """Magnitudes of the two-dimensional Fourier transform of an n by n image."""
    c, s = waves(n)
    real = both(separable(m, c, c), separable(m, s, s), lambda a, b: a - b)
    imaginary = both(separable(m, c, s), separable(m, s, c), lambda a, b: a + b)
    return both(real, imaginary, lambda a, b: F.sqrt(a * a + b * b))


def ssim_map(a: Column, b: Column, window: np.ndarray) -> Column:
    """Structural similarity at each pixel, with means and variances under a smoothing window."""
    c1, c2 = 6.5025, 58.5225  # fixed values: (0.01 * 255)^2 and (0.03 * 255)^2
    smooth = lambda m: F.flatten(separable(m, window, window))
    product = lambda x, y: both(x, y, lambda p, q: p * q)

    def at(p: Column) -> Column:
        x, y = p["a"], p["b"]
        return (2 * x * y + c1) * (2 * (p["ab"] - x * y) + c2) / ((x * x + y * y + c1) * (p["aa"] - x * x + p["bb"] - y * y + c2))

    def of(m: Column) -> Column:
        x, y = m["a"], m["b"]
        return F.transform(F.arrays_zip(smooth(x).alias("a"), smooth(y).alias("b"), smooth(product(x, x)).alias("aa"), smooth(product(y, y)).alias("bb"), smooth(product(x, y)).alias("ab")), at)

    return let(F.struct(a.alias("a"), b.alias("b")), of)
