"""Nearest-neighbour scores against a bank of normal vectors.

Blocks of queries meet blocks of the bank on a grid, so neither side is broadcast or collected;
distances within a cell are products of tiles, of which only the nearest are kept, and the cells' nearest are merged by query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a cell's sides at most, and rows of either that are multiplied at a time.
QUERIES, BANK = 16_384, 32_768
QUERY_TILE, BANK_TILE = 128, 1024
#: Queries of a cell at least, where they are parted only to occupy all cores.
FEW = 1024


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of a from all rows of b, in double."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None]
    out -= 2 * a @ b.T
    return np.maximum(out, 0, out=out)


def lowest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the k lowest of each row, in order, ties to the first; one pass each. Overwrites d."""
    k = min(k, d.shape[1])
    if k > 16:
        at = np.argsort(d, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(d, at, 1)
    rows, at, found = np.arange(len(d)), np.empty((len(d), k), np.int64), np.empty((len(d), k))
    for n in range(k):
        at[:, n] = d.argmin(1)
        found[:, n] = d[rows, at[:, n]]
        d[rows, at[:, n]] = np.inf
    return at, found


def nearest(q: np.ndarray, b: np.ndarray, k: int, first: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in b of the k nearest of each row of q, in order, ties to the first, and their distances (inf: none).

    ``first`` and ``end``: places in b, for each row of q, that are left out. Tiles bound the memory, whatever the sides' sizes.
    """
    whole = np.isfinite(q).all() and np.isfinite(b).all()
    all_at, all_found = [], []
    for i in range(0, len(q), QUERY_TILE):
        rows, at, found = q[i : i + QUERY_TILE], None, None
        for j in range(0, len(b), BANK_TILE):
            d = squares(rows, b[j : j + BANK_TILE])
            if not whole:
                d[~np.isfinite(d)] = np.inf
            if first is not None and end is not None:
                low, high = np.maximum(first[i : i + QUERY_TILE], j), np.minimum(end[i : i + QUERY_TILE], j + d.shape[1])
                for r in np.flatnonzero(low < high):
                    d[r, low[r] - j : high[r] - j] = np.inf
            new_at, new = lowest(d, k)
            if at is None:
                at, found = new_at + j, new
                continue
            at, found = np.concatenate([at, new_at + j], 1), np.concatenate([found, new], 1)
            best = np.argsort(found, axis=1, kind="stable")[:, :k]
            at, found = np.take_along_axis(at, best, 1), np.take_along_axis(found, best, 1)
        all_at.append(at)
        all_found.append(np.sqrt(found))
    return np.concatenate(all_at), np.concatenate(all_found)


def _vectors(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), float)


def _cell(k: int, leave_own: bool):
    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "bank_id": [], "distance": []}).astype({"query_id": "int64", "bank_id": "int64"})
        right = right.sort_values("id")
        ids, of = right["id"].to_numpy(), left["id"].to_numpy()
        own = (np.searchsorted(ids, of, "left"), np.searchsorted(ids, of, "right")) if leave_own else (None, None)
        at, d = nearest(_vectors(left["v"]), _vectors(right["v"]), k, *own)
        out = pd.DataFrame({"query_id": np.repeat(of, at.shape[1]), "bank_id": ids[at].ravel(), "distance": d.ravel()})
        return out[np.isfinite(out["distance"])]

    return found


def _cells(queries: DataFrame, bank: DataFrame) -> tuple[int, int]:
    """Parts of the queries and of the bank: as few as cells can hold, so that rows are sent to few cells, but queries for all cores."""
    n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-n // QUERIES), min(cores, -(-n // FEW))), max(1, -(-bank.count() // BANK))


def neighbours(queries: DataFrame, bank: DataFrame, k: int, leave_own: bool = False) -> DataFrame:
    """query_id, rank (from 1), bank_id, distance of the k nearest. Both sides: id long, v array; ties to the smaller id.

    With ``leave_own`` a query's own id is no neighbour of it (leave one out).
    """
    a, b = _cells(queries, bank)
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select("id", "v", part(a).alias("i"), grid(b).alias("j"))
    right = bank.select("id", "v", grid(a).alias("i"), part(b).alias("j"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_cell(k, leave_own), "query_id long, bank_id long, distance double")
    best = Window.partitionBy("query_id").orderBy("distance", "bank_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "bank_id", "distance")


def scores(queries: DataFrame, bank: DataFrame, k: int = 1, leave_own: bool = False) -> DataFrame:
    """id, score: mean distance of the k nearest."""
    return neighbours(queries, bank, k, leave_own).groupBy(F.col("query_id").alias("id")).agg(F.avg("distance").alias("score"))


def _layer_cell(k: int, layers: dict[str, tuple[int, int]]):
    def found(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "layer": [], "bank_id": [], "distance": []}).astype({"query_id": "int64", "layer": "str", "bank_id": "int64"})]
        if len(left) and len(right):
            right = right.sort_values("id")
            ids, own = left["id"].to_numpy(), right["layers"].map(set)
            q, b = _vectors(left["v"]), _vectors(right["v"])
            for name, (first, end) in layers.items():
                of = np.array([name in x for x in own])
                if of.any():
                    at, d = nearest(q[:, first:end], b[of, first:end], k)
                    out.append(pd.DataFrame({"query_id": np.repeat(ids, at.shape[1]), "layer": name, "bank_id": right["id"].to_numpy()[of][at].ravel(), "distance": d.ravel()}))
        return pd.concat(out)

    return found


def layer_scores(queries: DataFrame, bank: DataFrame, layers: dict[str, tuple[int, int]], k: int = 1) -> DataFrame:
    """id, layer, score: mean distance of the k nearest in each layer's own bank, in the components that the layer takes (first, end).

    ``queries``: id, v. ``bank``: id, v and layers, the names of the banks that a row is in. All layers are scored in one pass: each side is
    read and dealt once, and a cell compares its rows layer by layer. A layer whose bank is empty gives no rows.
    """
    a, b = _cells(queries, bank)
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = queries.select("id", "v", part(a).alias("i"), grid(b).alias("j"))
    right = bank.select("id", "v", "layers", grid(a).alias("i"), part(b).alias("j"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_layer_cell(k, layers), "query_id long, layer string, bank_id long, distance double")
    best = Window.partitionBy("query_id", "layer").orderBy("distance", "bank_id")
    nearest = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return nearest.groupBy(F.col("query_id").alias("id"), "layer").agg(F.avg("distance").alias("score"))
