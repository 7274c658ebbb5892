"""Decoded files, bitmaps, the model store, pooled maps and layer sets."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.operators import grid, knn
from seamline.sources import pixels, store


def png(rows: np.ndarray) -> bytes:
    """Bytes of a PNG of (h, w) grey or (h, w, 3) colour values."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = rows.shape[:2]
    lines = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in rows)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if rows.ndim == 3 else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def weighed(c):
    return np.floor(0.299 * c[..., 0] + 0.587 * c[..., 1] + 0.114 * c[..., 2] + 0.5)


def test_files_to_pixels(spark, tmp_path):
    rng = np.random.default_rng(2)
    one, colour = rng.integers(0, 256, (5, 7)), rng.integers(0, 256, (6, 4, 3))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "grey.png").write_bytes(png(one))
    (tmp_path / "a" / "colour.png").write_bytes(png(colour))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG no image")
    image_io = spark._jvm.javax.imageio.ImageIO
    image_io.write(image_io.read(spark._jvm.java.io.File(str(tmp_path / "a" / "grey.png"))), "jpg", spark._jvm.java.io.File(str(tmp_path / "photo.jpg")))
    images, bad = pixels.decoded(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in images.collect()}
    assert {r.path.rsplit("/", 1)[1] for r in bad.collect()} == {"bad.png"} and set(got) == {"grey.png", "colour.png", "photo.jpg"}
    assert (got["grey.png"].height, got["grey.png"].width, got["grey.png"].channels) == (5, 7, 1) and got["grey.png"].pixels == one.ravel().tolist()
    assert got["colour.png"].channels == 3 and got["colour.png"].pixels == weighed(colour).ravel().tolist()
    assert len(got["photo.jpg"].pixels) == 35 and np.abs(np.array(got["photo.jpg"].pixels) - one.ravel()).mean() < 40


def test_bitmaps(spark):
    rng = np.random.default_rng(3)
    h, w = 4, 5
    colour = rng.integers(0, 256, (h, w, 3))
    row = -(-w * 3 // 4) * 4
    body = b"".join(line[:, ::-1].astype(np.uint8).tobytes().ljust(row, b"\0") for line in colour[::-1])
    full = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body
    data = [(0, bytearray(full)), (1, bytearray(full[:-1])), (2, bytearray(b"BM" + bytes(60))), (3, bytearray(b"")), (4, None), (5, bytearray(b"XY" + full[2:]))]
    got = {r.i: r.b for r in spark.createDataFrame(data, "i int, d binary").select("i", pixels.bitmap(F.col("d")).alias("b")).collect()}
    assert got[0].pixels == weighed(colour).ravel().tolist() and (got[0].height, got[0].width) == (h, w)
    assert all(got[i] is None for i in range(1, 6))
    flat = rng.integers(0, 256, 6 * 9).tolist()
    back = spark.createDataFrame([(flat,)], "p array<int>").select(pixels.bitmap(pixels.to_bitmap(F.col("p"), 6, 9)).alias("b")).first().b
    assert back.pixels == flat and (back.height, back.width) == (6, 9)


def test_store(spark, tmp_path):
    root = str(tmp_path / "models")
    bank = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "id long, v array<double>")
    assert store.versions(spark, root).count() == 0
    with pytest.raises(KeyError):
        store.load(spark, root, "bank", "a")
    assert store.save(root, {"bank": bank, "mask": bank.select("id")}, "a") == 1
    assert store.save(root, {"bank": bank.where("id < 3")}, "b-1.x") == 1
    assert store.save(root, {"bank": bank.where("id >= 4")}, "a") == 2
    assert {r.id for r in store.load(spark, root, "bank", "a").collect()} == set(range(4, 10))
    assert {r.id for r in store.load(spark, root, "bank", "b-1.x").collect()} == {0, 1, 2}
    with pytest.raises(KeyError):
        store.load(spark, root, "mask", "a")  # the version in use has none
    assert {(r.model, r.id) for r in store.load_all(spark, root, "bank").collect()} == {("a", i) for i in range(4, 10)} | {("b-1.x", i) for i in range(3)}
    files = {f.split("/bank/")[1].rsplit("/", 1)[0] for f in store.load(spark, root, "bank", "a").inputFiles()}
    assert files == {"model=a/version=2"}
    with pytest.raises(ValueError, match="name"):
        store.save(root, {"bank": bank}, "a/b")


def test_a_fit_that_fails_leaves_the_one_before(spark, tmp_path):
    root = str(tmp_path / "models")
    bank = spark.range(5)
    store.save(root, {"bank": bank}, "a")
    broken = bank.select(F.raise_error(F.lit("no fit")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no fit"):
        store.save(root, {"bank": broken}, "a")
    assert store.load(spark, root, "bank", "a").count() == 5
    assert store.save(root, {"bank": bank.where("id > 2")}, "a") == 2 and store.load(spark, root, "bank", "a").count() == 2


@pytest.mark.parametrize(("size", "stride"), [(3, 1), (3, 3), (2, 1), (1, 2)])
def test_pooled_vectors(spark, size, stride):
    v = np.random.default_rng(4).normal(size=(7, 8, 5))
    cells = [(1, i, j, v[i, j].tolist()) for i in range(7) for j in range(8)] + [(2, 0, 0, [1.0] * 5)]
    got = {(r.image, r.row, r.col): r.v for r in grid.pooled(spark.createDataFrame(cells, "image int, row int, col int, v array<double>"), ["image"], size, stride).collect()}
    want = {(1, i // stride, j // stride): v[i : i + size, j : j + size].mean((0, 1)) for i in range(0, 8 - size, stride) for j in range(0, 9 - size, stride)}
    assert {k for k in got if k[0] == 1} == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    assert len(got) - len(want) == (size == 1)


def test_layer_sets(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERIES", 20)
    monkeypatch.setattr(knn, "BANK", 15)
    rng = np.random.default_rng(5)
    q, b = rng.normal(size=(60, 8)), rng.normal(size=(50, 8))
    layers = {"low": (0, 3), "all": (0, 8), "none": (2, 4)}
    of = [[*(["low"] if i % 2 else []), *(["all"] if i % 3 else [])] for i in range(50)]
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "id long, v array<double>")
    bank = spark.createDataFrame([(i, x.tolist(), n) for i, (x, n) in enumerate(zip(b, of, strict=True))], "id long, v array<double>, layers array<string>")
    got = {(r.id, r.layer): r.score for r in knn.layer_scores(queries, bank, layers, 4).collect()}
    assert len(got) == 120
    for name, (first, end) in list(layers.items())[:2]:
        rows = b[[name in n for n in of], first:end]
        d = np.sort(np.linalg.norm(q[:, None, first:end] - rows[None], axis=2), axis=1)[:, :4].mean(1)
        assert np.allclose([got[i, name] for i in range(60)], d)
