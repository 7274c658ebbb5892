"""Operators on hand-made rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.functions import matrices, names, stats, vectors
from seamline.operators import catalog, coreset, ensemble, evaluate, grid, knn, metrics, ranks, raster, selfval
from seamline.sources import images
from seamline.streaming.scorer import score_stream


def test_spec_names(spark):
    rows = ["20240101_596x199", "20240101_H700x300", "20240101_W12x8x40", "HP14x89", "x_HP14x89", "x_SP200x90", "x_HP14x73x89", "x_W11x5x6", "nothing", "x_HP11x73x89", ""]
    df = spark.createDataFrame([(r,) for r in rows], "name string")
    got = [tuple(r.s) if r.s else None for r in df.select(names.parse_spec(F.col("name")).alias("s")).collect()]
    assert got == [("596x199", 596, 199), ("H700x300", 700, 300), ("W12x8x40", 305, 305), None, None, None, ("HP14x73x89", 356, 356), None, None, ("HP11x73x89", 73, 73), None]
    keys = spark.createDataFrame([("H700x300",), ("HP14x73x89",), ("596x199",)], "raw string").select(names.spec_key(F.col("raw")).alias("k")).collect()
    assert [r.k for r in keys] == ["700x300", "HP14x73x89", "596x199"]
    dates = df.select(names.prod_date(F.col("name")).alias("d")).collect()
    assert str(dates[0].d) == "2024-01-01" and dates[3].d is None


def test_natural_order(spark):
    df = spark.createDataFrame([("10_100",), ("9_5",), ("10_99",)], "file string")
    assert [r.file for r in df.orderBy(names.natural_key(F.col("file"))).collect()] == ["9_5", "10_99", "10_100"]


def test_trim_at_its_edge(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(5)], "g string, i int")
    assert [tuple(r) for r in catalog.trim_stride(df, ["g"], ["i"], 2, 2).collect()] == [("b", 2)]


def test_stratified_fills_up(spark):
    df = spark.createDataFrame([(f"a{i}", "d1") for i in range(1)] + [(f"b{i}", "d2") for i in range(10)], "name string, prod_date string")
    got = catalog.stratified(df, 6).collect()
    assert len(got) == 6 and {r.name for r in got} >= {"a0"}
    assert catalog.adaptive_step(10, 2, 2000) == 7 and catalog.adaptive_step(1, 1, 9999) == 1


def test_grid_and_heat(spark):
    assert grid.tiles(spark, 1920, 1200, 256, 256).count() == 28 and grid.tiles(spark, 1920, 1200, 64, 32).count() == 59 * 36
    heat = grid.overlap_heatmap(spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0)], "tile_x int, tile_y int, score double"), 2, 1).collect()
    assert {(r.cell_x, r.cell_y): r.heat for r in heat}[1, 0] == 2.0


def test_neighbours_with_ties_and_own(spark):
    bank = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0])], "id long, v array<double>")
    got = [(r.query_id, r.rank, r.bank_id, r.distance) for r in knn.neighbours(bank, bank, 2).orderBy("query_id", "rank").collect()]
    assert got[:4] == [(1, 1, 1, 0.0), (1, 2, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 2, 0.0)]
    own = {r.id: r.score for r in knn.scores(bank, bank, 1, leave_own=True).collect()}
    assert own == {1: 0.0, 2: 0.0, 3: 5.0}
    assert knn.scores(bank, bank.where("id < 0")).count() == 0


def test_neighbours_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 7)
    monkeypatch.setattr(knn, "BANK", 5)
    v = np.random.default_rng(0).normal(size=(40, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    want = np.sort(np.linalg.norm(v[:, None] - v[None], axis=2), axis=1)[:, :3].mean(1)
    got = {r.id: r.score for r in knn.scores(df, df, 3).collect()}
    assert np.allclose([got[i] for i in range(40)], want)


def test_coreset_radius_falls(spark):
    v = np.random.default_rng(1).normal(size=(200, 4))
    radius = [np.linalg.norm(v[:, None] - v[coreset.farthest_points(v, k)][None], axis=2).min(1).max() for k in (1, 5, 20, 80, 200, 300)]
    assert radius == sorted(radius, reverse=True) and radius[-1] == 0
    assert coreset.farthest_points(np.zeros((3, 2)), 1).tolist() == [0]
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "model int, id long, v array<double>")
    parted = coreset.partitioned(df, 0.1, rows=60).collect()
    assert 10 <= len(parted) <= 30 and len({r.id for r in parted}) == len(parted)


def test_partitioned_coreset_of_two_models_with_shared_ids(spark):
    """Models don't meet, ids may repeat between them, and no part takes a whole union."""
    v = np.random.default_rng(3).normal(size=(300, 3))
    df = spark.createDataFrame([(m, i, (x + m).tolist()) for m in (0, 1) for i, x in enumerate(v)], "model int, id long, v array<double>")
    got = coreset.partitioned(df, 0.1, rows=40).collect()
    assert len({(r.model, r.id) for r in got}) == len(got)
    for m in (0, 1):
        own = {r.id: r.v for r in got if r.model == m}
        assert 15 <= len(own) <= 75 and all(np.allclose(own[i], v[i] + m) for i in own)
    assert {r.id for r in coreset.capped(df.where("model = 0"), 20).collect()} == set(sorted(range(300), key=lambda i: (__import__("hashlib").md5(str(i).encode()).hexdigest()[:12], i))[:20])


def test_greedy_coreset_against_brute_force(spark):
    v = np.random.default_rng(4).normal(size=(50, 3))
    df = spark.createDataFrame([(0, i, x.tolist()) for i, x in enumerate(v)], "model int, id long, v array<double>")
    picks = [0]
    while len(picks) < 10:
        picks.append(max(range(50), key=lambda i: (min(np.linalg.norm(v[i] - v[p]) for p in picks), -i)))
    assert [r.id for r in coreset.greedy(df, 0.2).orderBy("pick").collect()] == picks


def test_self_validation_against_brute_force(spark):
    """One round: bank, scores, rejection over the higher of both limits; then the bank and threshold of what is left."""
    rng = np.random.default_rng(5)
    v = np.r_[rng.normal(size=(60, 2)), [[9.0, 9.0]], [[-8.0, 7.0]]]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    bank = v[coreset.farthest_points(v, 6)]
    score = np.linalg.norm(v[:, None] - bank[None], axis=2).min(1)
    mad = np.median(abs(score - np.median(score)))
    limit = max(np.median(score) + 3.5 * 1.4826 * mad, np.percentile(score, 95))
    kept, rebuilt, threshold = selfval.validate_once(df, 0.1)
    assert {r.id for r in kept.collect()} == set(np.flatnonzero(score <= limit).tolist())
    left = v[score <= limit]
    again = left[coreset.farthest_points(left, int(len(left) * 0.1))]
    assert sorted(map(tuple, again.tolist())) == sorted(tuple(r.v) for r in rebuilt.collect())
    s = np.linalg.norm(left[:, None] - again[None], axis=2).min(1)
    t = threshold.first()
    assert math.isclose(t.threshold, np.median(s) + 3.5 * 1.4826 * np.median(abs(s - np.median(s))))


def test_ranks_of_equal_values_are_parted(spark):
    """A group of one value: dealt by tie, ranks without gaps."""
    df = spark.range(5000).select(F.lit("a").alias("k"), F.lit(2.5).alias("x"), F.col("id").alias("i"))
    placed = ranks.ranked(df, ["k"], "x", ["i"], part_rows=400)
    assert [(r.i, r["rank"], r.n) for r in placed.orderBy("i").collect()] == [(i, i, 5000) for i in range(5000)]
    assert ranks.percentiles(df, ["k"], "x", {"p": 0.3, "q": 1.0}, accuracy=10).first().asDict() == {"k": "a", "p": 2.5, "q": 2.5}


def test_percentiles_of_brackets(spark):
    """Groups beyond the accuracy, with ties, against NumPy."""
    rng = np.random.default_rng(8)
    rows = [(k, float(x)) for k, n in (("a", 3000), ("b", 900), ("c", 1), ("d", 2)) for x in np.round(rng.lognormal(size=n), 1 if k == "b" else 9)] + [("a", None)]
    shares = {"lowest": 0.0, "p1": 0.01, "p50": 0.5, "p73": 0.737, "p999": 0.999, "top": 1.0}
    got = {r.k: r for r in ranks.percentiles(spark.createDataFrame(rows, "k string, x double").repartition(5), ["k"], "x", shares, accuracy=100).collect()}
    for k in "abcd":
        x = [v for g, v in rows if g == k and v is not None]
        assert np.allclose([got[k][n] for n in shares], [np.quantile(x, p) for p in shares.values()])
    whole = ranks.percentiles(spark.createDataFrame(rows, "k string, x double"), [], "x", {"m": 0.5}, accuracy=100).first().m
    assert np.isclose(whole, np.median([v for _, v in rows if v is not None]))


def test_ranks_and_percentiles(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=500), 1)
    df = spark.createDataFrame([("ab"[i % 2], i, float(a)) for i, a in enumerate(x)], "k string, i long, x double")
    got = {r.k: r for r in ranks.percentiles(df, ["k"], "x", {"p5": 0.05, "p50": 0.5, "p99": 0.99}, accuracy=40).collect()}
    for j, k in enumerate("ab"):
        assert np.allclose([got[k].p5, got[k].p50, got[k].p99], np.percentile(x[j::2], [5, 50, 99]))
    placed = ranks.ranked(df, ["k"], "x", ["i"], part_rows=60).where("k = 'a'").orderBy("rank").collect()
    assert [r.i for r in placed] == sorted(range(0, 500, 2), key=lambda i: (x[i], i)) and [r["rank"] for r in placed] == list(range(250))


def test_matrices_against_numpy(spark):
    img = np.random.default_rng(7).uniform(0, 255, (8, 8))
    other = np.clip(img + 9, 0, 255)
    df = spark.createDataFrame([(img.ravel().tolist(), other.ravel().tolist())], "a array<double>, b array<double>")
    m, o = matrices.rows_of(F.col("a"), 8), matrices.rows_of(F.col("b"), 8)
    half, window = matrices.bilinear(8, 4), matrices.gaussian(8, 1.5, 5)
    r = df.select(matrices.separable(m, half, half).alias("half"), matrices.spectrum(m, 8).alias("spectrum"), matrices.separable(m, matrices.dct(8), matrices.dct(8)).alias("dct"), matrices.ssim_map(m, o, window).alias("ssim")).first()
    assert np.allclose(r.half, img.reshape(4, 2, 4, 2).mean((1, 3)))
    assert np.allclose(r.spectrum, abs(np.fft.fft2(img))) and np.isclose((np.array(r.dct) ** 2).sum(), (img**2).sum())
    pad = np.pad(img, 5, mode="reflect")
    k = np.exp(-(np.arange(-5, 6) ** 2) / 4.5)
    k /= k.sum()
    smooth = np.array([[(pad[y : y + 11, x : x + 11] * np.outer(k, k)).sum() for x in range(8)] for y in range(8)])
    assert np.allclose(window @ img @ window.T, smooth)
    g = lambda z: window @ z @ window.T
    p, q = g(img), g(other)
    want = (2 * p * q + 6.5025) * (2 * (g(img * other) - p * q) + 58.5225) / ((p**2 + q**2 + 6.5025) * (g(img * img) - p**2 + g(other * other) - q**2 + 58.5225))
    assert np.allclose(r.ssim, want.ravel())


def test_raster_measures_against_brute_force(spark):
    img = np.random.default_rng(8).uniform(0, 255, (8, 8))
    df = spark.createDataFrame([(3, 8, img.ravel().tolist())], "id long, width int, pixels array<double>")
    r = next(x for x in raster.measure(df).collect() if x.kind == "clean")
    k = np.arange(8)
    wave = np.exp(-2j * np.pi * np.outer(k, k) / 8)
    assert math.isclose(r.fft_high, raster.fft_high(img)) and np.allclose(wave @ img @ wave.T, np.fft.fft2(img))
    assert math.isclose(r.multires, np.mean([img.std(), img.reshape(4, 2, 4, 2).mean((1, 3)).std(), img.reshape(2, 4, 2, 4).mean((1, 3)).std()]))
    c = matrices.dct(8) @ img @ matrices.dct(8).T
    assert np.allclose(raster.dct2(img), c) and abs(r.ssim_distance) < 1e-12


def test_pca_error_against_numpy(spark, sf_dir):
    from seamline.plans import queries

    got = {r.id: r.error for r in queries.QUERIES["pca_recon_error"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    v, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    bank = v[ids % 5 == 0]
    _, _, axes = np.linalg.svd(bank - bank.mean(0), full_matrices=False)
    c = v - bank.mean(0)
    want = np.linalg.norm(c - c @ axes[:8].T @ axes[:8], axis=1)
    assert np.allclose([got[i] for i in ids.tolist()], want, atol=1e-5)


def test_malformed_lines(spark):
    df = spark.createDataFrame([("cam=1, kind=a",), ("no fields",), ("cam=, =x, kind=b=c",), ("",), (None,)], "line string")
    got = [r.f for r in df.select(names.log_fields(F.col("line")).alias("f")).collect()]
    assert got == [{"cam": "1", "kind": "a"}, {}, {"kind": "b=c"}, {}, None]
    sizes = spark.createDataFrame([("50X200",), ("200x50",), ("x",), ("",)], "s string").select(names.wide_first(F.col("s")).alias("w")).collect()
    assert [r.w for r in sizes] == ["200x50", "200x50", None, None]


def test_thresholds_and_rejection(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(20)] + [("a", 100.0)], "k string, score double")
    t = selfval.mad_threshold(df, ["k"]).first()
    assert t.median == 10 and t.mad == 5 and math.isclose(t.threshold, 10 + 3.5 * 1.4826 * 5)
    assert [r.score for r in selfval.rejected(df, selfval.capped_threshold(df, ["k"]), ["k"]).collect()] == [100.0]


def test_position_floors(spark):
    few = spark.createDataFrame([(i, 0, 5.0) for i in range(3)] + [(i, 1, 5.0) for i in range(12)], "image_id long, pos int, score double")
    assert {r.pos: r.std for r in metrics.position_stats(few).collect()} == {0: 0.1, 1: 0.01}


def test_clusters_and_runs(spark):
    cells = [(0, 0), (0, 1), (1, 1), (3, 3), (3, 4), (4, 3), (5, 3)]
    df = spark.createDataFrame([(7, r, c, 9.0, 9.0) for r, c in cells] + [(7, 9, 9, 0.0, 0.0), (8, 0, 0, 0.0, 0.0)], "image_id long, row int, col int, score double, z double")
    got = metrics.cluster_score(df, 1.0).first()
    assert got.largest == 4 and round(got.cluster_score, 4) == 5.2915
    m = {r.image_id: r for r in metrics.image_metrics(df, 1.0).collect()}
    assert m[7].max_vertical_run == 3 and m[7].anomaly_count == 7 and m[8].cluster_score == 0 and m[8].z_skewness == 0


def test_first_metric_wins_a_tie(spark):
    z = spark.createDataFrame([(1, "b", 2.0), (1, "a", 2.0)], "image_id long, metric string, z double")
    assert ensemble.ens_max_z(z, ["b", "a"]).first().dominant_metric == "b"


def test_sweep_and_auroc(spark):
    df = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True)], "score double, label boolean")
    t = {r.threshold: r for r in evaluate.sweep(df, [0.0, 2.0, 9.0]).collect()}
    assert (t[2.0].tp, t[2.0].fp, t[2.0].fn, t[2.0].tn) == (1, 0, 1, 2) and t[9.0].f1 == 0 and t[9.0].precision == 0
    assert evaluate.auroc(df).first().auroc == 0.875
    assert math.isclose(evaluate.auroc(df.withColumn("score", -F.col("score"))).first().auroc, 0.125)


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"),), (2.0,)], "x double")
    assert df.agg(F.avg(stats.number(F.col("x"))).alias("m")).first().m == 2.0
    assert df.where("x = 2").select(stats.bin_of(F.col("x"), F.lit(0.0), F.lit(2.0), 4).alias("b")).first().b == 3


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(vectors.distance(F.col("a"), F.col("b")).alias("d"), vectors.project(F.col("a"), [[1, 0], [1, 1]]).alias("p")).first()
    assert r.d == 5 and list(r.p) == [3.0, 7.0]


def test_raster():
    flat = np.full((16, 16), 9.0)
    assert raster.sobel(flat) == 0 and raster.multires(flat) == 0 and abs(raster.ssim_distance(flat, flat)) < 1e-12
    img = np.random.default_rng(2).uniform(0, 255, (16, 16))
    assert math.isclose((raster.dct2(img) ** 2).sum(), (img**2).sum())
    for kind in raster.KINDS:
        assert raster.ssim_distance(raster.inject(img, kind, 3), img) > 0


def test_image_store(spark, tmp_path):
    for folder, cam, file in (("20240101_596x199", 1, "9_5.jpg"), ("20240101_596x199", 1, "10_99.jpg"), ("20240101_596x199", 2, "1.JPG"), ("20240102_H700x300", 2, "1.jpg"), ("20240101_596x199", 1, "note.txt")):
        p = tmp_path / "20240101" / folder / f"camera_{cam}"
        p.mkdir(parents=True, exist_ok=True)
        (p / file).write_bytes(b"x")
    found = images.listing(spark, str(tmp_path))
    assert found.count() == 4
    assert [r.spec_key for r in images.folders(found).collect()] == ["596x199"]
    assert [r.file for r in images.ordered(found).where("folder like '%596%' and cam_id = 1").orderBy("img_idx").collect()] == ["9_5.jpg", "10_99.jpg"]
    assert {r.folder: (r.cam_1, r.cam_2, r.total) for r in images.inventory(found).collect()}["20240101_596x199"] == (2, 1, 3)
    images.write_lines(found, ["folder", "file"], str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


@pytest.mark.parametrize("threshold", [1.0])
def test_stream(spark, tmp_path, threshold):
    schema = "id long, v array<double>"
    spark.createDataFrame([(1, [0.0, 0.0]), (2, [9.0, 9.0])], schema).write.parquet(str(tmp_path / "in"))
    bank = spark.createDataFrame([(0, [0.0, 0.5])], schema)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    score_stream(stream, bank, threshold, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.id: r.anomaly for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: False, 2: True}


@pytest.mark.parametrize(("rows", "block_rows", "offered", "ratio"), [(400, 50, 20, 0.1), (400, 1000, 1000, 0.3), (60, 5, 3, 1.0)])
def test_exact_coreset_of_many_blocks(spark, rows, block_rows, offered, ratio):
    """The same picks in the same order as one pass, also with equal rows and distances that tie."""
    rng = np.random.default_rng(rows)
    v = np.round(rng.normal(size=(rows, 4)) * 3) / 2 if rows < 100 else rng.normal(size=(rows, 6)) + 5 * rng.integers(0, 3, (rows, 1))
    v = v[np.unique(v, axis=0, return_index=True)[1]] if ratio == 1 else v
    df = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = sorted((r.pick, r.id) for r in coreset.exact(df, ratio, block_rows=block_rows, offered=offered).collect())
    want = coreset.farthest_points(v, max(1, int(len(v) * ratio)))
    assert got == [(k, int(i) * 3) for k, i in enumerate(want)]


def test_exact_coreset_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert coreset.exact(df, 0.5).count() == 0
    one = coreset.exact(spark.createDataFrame([(5, [1.0])], "id long, v array<double>"), 0.5).collect()
    assert [(r.id, r.pick) for r in one] == [(5, 0)]
