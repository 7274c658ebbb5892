"""Stencils and equalisation against NumPy, and job status as batch and stream."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import stencils
from seamline.operators import equalise, raster
from seamline.streaming import status


@pytest.mark.parametrize(("h", "w"), [(8, 8), (9, 13), (4, 5), (64, 64)])
def test_stencils_against_numpy(spark, h, w):
    rng = np.random.default_rng(h * w)
    a, b = rng.integers(0, 30, (h, w)).astype(float), rng.integers(0, 256, (h, w)).astype(float)
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist())], "a array<double>, b array<double>")
    A, B = F.col("a"), F.col("b")
    got = df.select(stencils.lbp(A, w).alias("lbp"), stencils.histogram(stencils.lbp(A, w)).alias("hist"), stencils.deviation(stencils.lbp(A, w)).alias("std"), stencils.chi_square(stencils.histogram(stencils.lbp(A, w)), stencils.histogram(stencils.lbp(B, w))).alias("chi"), stencils.mean(stencils.gradients(A, w)).alias("sobel"), stencils.deviation_by_scale(A, w).alias("multi"), stencils.worst_scale(A, B, w).alias("worst")).first()
    code, other = raster.lbp(a), raster.lbp(b)
    assert got.lbp == code.ravel().tolist() and got.hist == np.bincount(code.ravel(), minlength=256).tolist()
    assert np.isclose(got.std, code.std()) and np.isclose(got.sobel, raster.sobel(a)) and np.isclose(got.multi, raster.multires(a))
    p, q = (np.bincount(c.ravel(), minlength=256) / c.size for c in (code, other))
    assert np.isclose(got.chi, ((p - q)[p + q > 0] ** 2 / (p + q)[p + q > 0]).sum() / 2)
    small = lambda x, k: x[: h // k * k, : w // k * k].reshape(h // k, k, w // k, k).mean((1, 3))
    tops = [np.sort(np.abs(small(a, k) - small(b, k)).ravel())[::-1] for k in (1, 2, 4)]
    assert np.isclose(got.worst, max(t[: max(1, len(t) * 5 // 100)].mean() for t in tops))


def plain_clahe(img, rows, cols, clip):
    h, w = img.shape[0] // rows, img.shape[1] // cols
    limit, luts = max(int(clip * h * w / 256), 1), {}
    for r in range(rows):
        for c in range(cols):
            hist = np.bincount(img[r * h : (r + 1) * h, c * w : (c + 1) * w].ravel(), minlength=256)
            over = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + over // 256
            rest = over % 256
            if rest:
                hist[:: max(256 // rest, 1)][:rest] += 1
            luts[r, c] = np.minimum(np.rint(np.cumsum(hist) * (255.0 / (h * w))), 255)
    out = np.zeros(img.shape)
    for y in range(img.shape[0]):
        for x in range(img.shape[1]):
            fy, fx = y / h - 0.5, x / w - 0.5
            y0, x0 = int(np.floor(fy)), int(np.floor(fx))
            at = lambda j, i: luts[min(max(y0 + j, 0), rows - 1), min(max(x0 + i, 0), cols - 1)][img[y, x]]  # noqa: B023, E731
            out[y, x] = np.rint((at(0, 0) * (1 - fx + x0) + at(0, 1) * (fx - x0)) * (1 - fy + y0) + (at(1, 0) * (1 - fx + x0) + at(1, 1) * (fx - x0)) * (fy - y0))
    return out


@pytest.mark.parametrize(("h", "w", "rows", "cols", "clip"), [(8, 8, 2, 2, 2.0), (24, 36, 3, 4, 2.0), (128, 128, 8, 8, 2.0), (16, 16, 1, 1, 40.0)])
def test_clahe_against_numpy(spark, h, w, rows, cols, clip):
    rng = np.random.default_rng(h)
    images = [rng.integers(60, 90, (h, w)), np.full((h, w), 7), rng.integers(0, 256, (h, w))]
    df = spark.createDataFrame([(i, m.ravel().astype(float).tolist()) for i, m in enumerate(images)], "id int, pixels array<double>")
    got = {r.id: np.reshape(r.pixels, (h, w)) for r in equalise.clahe(df, w, h, rows, cols, clip).collect()}
    for i, m in enumerate(images):
        want = plain_clahe(m, rows, cols, clip)
        assert np.abs(got[i] - want).max() <= 1 and (got[i] != want).mean() < 0.001  # blends on a half may round either way


LINES = [("a", 1, "Scanning NAS"), ("a", 2, "\x1b[32mSpec: 150x75 | Group 2\x1b[0m"), ("a", 3, "Self-validation round 1/3"), ("a", 4, "Round 1 features: 40% done"), ("b", 1, "Spec: 200x200 | Group 5"), ("b", 9, "Scoring: 80%"), ("b", 5, "Mask cam_3: 12%"), ("a", 7, "Coreset selection ..."), ("a", 6, "Round 1 features: 90%"), ("c", 1, "nothing"), ("a", 2, "Spec: 150x75 | Group 2"), ("b", 9, "Scoring: 80%")]
WANT = {"a": ("150x75", 2, "1/3", "Coreset selection", None, 7), "b": ("200x200", 5, None, "Scoring", "80%", 9), "c": (None, None, None, None, None, 1)}
SCHEMA = "job string, at long, line string"


def test_status_as_a_batch(spark):
    got = {r[0]: tuple(r)[1:] for r in status.last_status(spark.createDataFrame(LINES, SCHEMA)).collect()}
    assert got == WANT
    assert status.last_status(spark.createDataFrame([], SCHEMA)).count() == 0


def test_status_as_a_stream(spark, tmp_path):
    """Lines that come late or again, over several runs of the stream, end in the batch's table."""
    for n, part in enumerate((LINES[5:9], LINES[:5], LINES[8:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        lines = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        status.status_stream(lines, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        if n == 0:
            assert {r.job for r in status.current_status(spark, str(tmp_path / "out")).collect()} == {"a", "b"}
    got = {r[0]: tuple(r)[1:] for r in status.current_status(spark, str(tmp_path / "out")).collect()}
    assert got == WANT


def test_names_are_parsed_once_for_the_nearest_spec(spark, sf_dir):
    """The plan that finds the nearest reads specs that are counted already, not orders again."""
    from seamline.plans.queries import QUERIES

    plan = QUERIES["catalog_fallback_nearest"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan and "o_custkey" not in plan
