"""Nearest rows by tiles: as by all distances at once, with ties to the first, in bounded memory."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from seamline.operators import knn


@pytest.mark.parametrize("k", [1, 3, 20])
def test_tiles_find_what_all_distances_give(monkeypatch, k):
    monkeypatch.setattr(knn, "QUERY_TILE", 7)
    monkeypatch.setattr(knn, "BANK_TILE", 9)
    rng = np.random.default_rng(k)
    b = rng.integers(0, 3, (60, 3)).astype(float)  # many ties
    first, end = np.arange(60), np.arange(60) + 1
    d = np.sqrt(((b[:, None] - b[None]) ** 2).sum(2))
    for own in (False, True):
        want = d + np.where(np.eye(60) > 0, np.inf, 0) if own else d
        at, found = knn.nearest(b, b, k, *((first, end) if own else ()))
        order = np.argsort(want, axis=1, kind="stable")[:, :k]
        assert (at == order).all() and np.allclose(found, np.take_along_axis(want, order, 1))


def test_missing_components_are_no_neighbours():
    b = np.array([[0.0, 0.0], [np.nan, 0.0], [1.0, 0.0]])
    at, found = knn.nearest(b, b, 2)
    assert at[0].tolist() == [0, 2] and at[2].tolist() == [2, 0] and not np.isfinite(found[1]).any()
    out = knn._cell(3, True)(pd.DataFrame({"id": [5, 6, 7], "v": list(b)}), pd.DataFrame({"id": [7, 5, 6], "v": [b[2], b[0], b[1]]}))
    assert out[["query_id", "bank_id"]].to_numpy().tolist() == [[5, 7], [7, 5]]


def test_a_large_cell_takes_little_memory():
    """All distances of such a cell are 512 MB, and several times that with their order."""
    rng = np.random.default_rng(0)
    q, b = rng.random((4000, 8)), rng.random((16_000, 8))
    tracemalloc.start()
    knn.nearest(q, b, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20
