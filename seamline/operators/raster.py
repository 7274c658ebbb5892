"""Image measures over small pixel arrays (grey, rows by columns), and synthetic defects."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Constants of structural similarity for 8-bit images.
C1, C2 = 6.5025, 58.5225


def fft_high(img: np.ndarray) -> float:
    """Mean spectrum outside a radius of a quarter of the smaller side."""
    f = np.abs(np.fft.fftshift(np.fft.fft2(img)))
    h, w = img.shape
    y, x = np.ogrid[:h, :w]
    return float(f[(y - h // 2) ** 2 + (x - w // 2) ** 2 > (min(h, w) // 4) ** 2].mean())


def dct2(img: np.ndarray) -> np.ndarray:
    """Orthonormal two-dimensional DCT-II."""

    def basis(n: int) -> np.ndarray:
        k, i = np.mgrid[:n, :n]
        m = np.sqrt(2 / n) * np.cos(np.pi * (2 * i + 1) * k / (2 * n))
        m[0] /= np.sqrt(2)
        return m

    return basis(img.shape[0]) @ img @ basis(img.shape[1]).T


def dct_high(img: np.ndarray) -> float:
    d = np.abs(dct2(img))
    return float(d[d.shape[0] // 2 :, d.shape[1] // 2 :].mean())


def lbp(img: np.ndarray) -> np.ndarray:
    """Local binary pattern of each inner pixel."""
    c, out = img[1:-1, 1:-1], np.zeros((img.shape[0] - 2, img.shape[1] - 2), np.int64)
    for bit, (dy, dx) in enumerate(((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0))):
        out |= (img[dy : dy + c.shape[0], dx : dx + c.shape[1]] >= c).astype(np.int64) << bit
    return out


def ssim_distance(a: np.ndarray, b: np.ndarray) -> float:
    """1 - structural similarity over the whole images."""
    cov = ((a - a.mean()) * (b - b.mean())).mean()
    return float(1 - (2 * a.mean() * b.mean() + C1) * (2 * cov + C2) / ((a.mean() ** 2 + b.mean() ** 2 + C1) * (a.var() + b.var() + C2)))


def sobel(img: np.ndarray) -> float:
    """Mean gradient magnitude of inner pixels."""
    s = lambda x: x[:-2] + 2 * x[1:-1] + x[2:]
    gx, gy = s(img[:, 2:] - img[:, :-2]), s((img[2:] - img[:-2]).T).T
    return float(np.hypot(gx, gy).mean())


def multires(img: np.ndarray) -> float:
    """Mean deviation over the image and its two-fold and four-fold block means."""
    def shrunk(k: int) -> np.ndarray:
        h, w = img.shape[0] // k * k, img.shape[1] // k * k
        return img[:h, :w].reshape(h // k, k, w // k, k).mean((1, 3))

    return float(np.mean([shrunk(k).std() for k in (1, 2, 4)]))


MEASURES = {"fft_high": fft_high, "dct_high": dct_high, "lbp_std": lambda x: float(lbp(x).std()), "sobel": sobel, "multires": multires}


def inject(img: np.ndarray, kind: str, seed: int) -> np.ndarray:
    """The image with one synthetic defect: spot, stain, scratch or gradient."""
    rng, out = np.random.default_rng(seed), img.astype(float).copy()
    h, w = img.shape
    y, x = np.mgrid[:h, :w]
    cy, cx, r = rng.integers(0, h), rng.integers(0, w), max(1, min(h, w) // 8)
    inside = (y - cy) ** 2 + (x - cx) ** 2 <= r * r
    if kind == "spot":
        out[inside] += 80
    elif kind == "stain":
        out -= 40 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * r * r))
    elif kind == "scratch":
        out[cy] += 60
    else:
        out += 40 * x / max(1, w - 1)
    return np.clip(out, 0, 255)


KINDS = ["spot", "stain", "scratch", "gradient"]


def measure(images: DataFrame) -> DataFrame:
    """id, kind (clean or a defect), and all measures, with 1 - similarity to the clean image. ``images``: id, width, pixels."""

    def run(frames):
        for pdf in frames:
            rows = []
            for i, width, pixels in zip(pdf["id"], pdf["width"], pdf["pixels"], strict=True):
                clean = np.asarray(pixels, float).reshape(-1, width)
                for kind in ["clean", *KINDS]:
                    img = clean if kind == "clean" else inject(clean, kind, int(i))
                    rows.append((i, kind, *(f(img) for f in MEASURES.values()), ssim_distance(img, clean)))
            yield pd.DataFrame(rows, columns=["id", "kind", *MEASURES, "ssim_distance"])

    return images.select("id", "width", "pixels").mapInPandas(run, "id long, kind string, " + ", ".join(f"{m} double" for m in [*MEASURES, "ssim_distance"]))
