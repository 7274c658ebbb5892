"""Banks of normal vectors by farthest-point selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.plans.lineage import cut, own_folder

from .ranks import ranked


def farthest_points(v: np.ndarray, target: int) -> np.ndarray:
    """Indices of ``target`` rows, from row 0 on, each farthest from those before; ties to the first."""
    picked, least = [0], ((v - v[0]) ** 2).sum(1)
    while len(picked) < min(target, len(v)):
        picked.append(int(least.argmax()))
        least = np.minimum(least, ((v - v[picked[-1]]) ** 2).sum(1))
    return np.array(picked)


def _greedy(ratio: float, least: int):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        at = farthest_points(np.array(pdf["v"].tolist(), float), max(least, int(len(pdf) * ratio)))
        out = pdf.iloc[at].copy()
        out["pick"] = range(len(at))
        return out[["model", "id", "v", "pick"]]

    return pick


def greedy(vectors: DataFrame, ratio: float, least: int = 1) -> DataFrame:
    """model, id, v, pick: the greedy coreset of each model (model int, id long, v array). One model is one task: partitioned() is for larger ones."""
    return vectors.select("model", "id", "v").groupBy("model").applyInPandas(_greedy(ratio, least), "model int, id long, v array<double>, pick int")


def capped(vectors: DataFrame, most: int, key: str = "id") -> DataFrame:
    """At most ``most`` rows, those whose key has the least md5; all if there are no more."""
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 12), 16, 10).cast("double")
    return ranked(vectors.withColumn("_md5", digest), [], "_md5", [key]).where(F.col("rank") < most).select(*vectors.columns)


def partitioned(vectors: DataFrame, ratio: float, rows: int = 20_000) -> DataFrame:
    """Composable coresets for models of any size: greedy within parts of about ``rows``, then within each model's union.

    The union is ``ratio`` of the model. Where it is still over ``rows``, it is parted again; once the parts
    hold their share already, their picks together are the coreset, and no task takes a union of any size.
    ``pick`` numbers the picks of a part. (model, id) identifies a row; models don't meet.
    """
    current, left = vectors.select("model", "id", "v"), ratio
    while True:
        most = current.groupBy("model").count().agg(F.max("count")).first()[0] or 0
        if most <= rows:
            return greedy(current, left)
        parts = -(-most // rows)
        share = max(left, 0.25)
        part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
        picked = current.withColumn("part", part).groupBy("model", "part").applyInPandas(_greedy(share, 1), "model int, id long, v array<double>, pick int")
        if left >= 0.25:
            return picked
        current, left = cut(picked.drop("pick")), left / share


#: Most blocks of an exact coreset, and rows that a round offers to the driver: both bound what it holds.
BLOCKS, OFFERED = 1024, 1024


def _nearest(points: np.ndarray, column: str, kind: str):
    """Squared distance of each row from the nearest of ``points``, or the number of that point."""

    def run(frames):
        for pdf in frames:
            v = np.array(pdf["v"].tolist(), float).reshape(len(pdf), points.shape[1])
            least, at = np.full(len(v), np.inf), np.zeros(len(v), np.int64)
            for n, p in enumerate(points):
                d = ((v - p) ** 2).sum(1)
                at[d < least] = n
                least = np.minimum(least, d)
            yield pdf.assign(**{column: at if kind == "number" else least})

    return run


def exact(vectors: DataFrame, ratio: float, least: int = 1, block_rows: int = 100_000, offered: int = OFFERED) -> DataFrame:
    """id, v, pick: the greedy coreset of one model of any size, the same rows in the same order as one pass would pick.

    ``vectors``: id long (each once), v array<double> of one length. Rows lie in blocks about BLOCKS pivots at most, partitioned by block; each row's squared distance from
    what is picked is kept apart. A round takes the ``offered`` rows that are farthest, and picks among them for as long as the farthest of them is
    over all other rows, whose distances only fall: those picks are exactly the next ones. Only blocks that a pick may be nearer to than
    what is picked already, by their middle and radius, are read again. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select("id", "v")
    n = rows.count()
    if not n:
        return rows.withColumn("pick", F.lit(0))
    target = min(n, max(least, int(n * ratio)))
    pivots = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(min(BLOCKS, -(-n // block_rows))).collect()], float)
    folder = own_folder(spark, "blocks")
    rows.mapInPandas(_nearest(pivots, "block", "number"), "id long, v array<double>, block long").repartition("block").write.partitionBy("block").parquet(folder)
    held = spark.read.schema("id long, v array<double>, block long").parquet(folder)
    radius = held.mapInPandas(_block_reach(pivots), "block long, far double").groupBy("block").agg(F.max("far").alias("far"))
    far = dict(radius.collect())  # a row a block
    start = rows.orderBy("id").first()
    ids, new = [start.id], np.array([start.v], float)
    state = held.select("id", "block", F.lit(float("inf")).alias("least"))
    most = dict.fromkeys(far, np.inf)
    while len(ids) < target:
        near = [b for b, r in far.items() if (np.sqrt(((new - pivots[b]) ** 2).sum(1)) - r < np.sqrt(most[b]) * (1 + 1e-9) + 1e-12).any()]
        read = held.where(F.col("block").isin(near)).mapInPandas(_nearest(new, "d", "distance"), "id long, v array<double>, block long, d double").select("id", "block", "d")
        state = cut(state.join(read, ["block", "id"], "left").select("id", "block", F.least("least", F.coalesce("d", "least")).alias("least")))
        most = dict(state.groupBy("block").agg(F.max("least")).collect())
        top = state.orderBy(F.desc("least"), "id").limit(offered + 1).collect()
        below = top[offered].least if len(top) > offered else -1.0
        chosen = spark.createDataFrame([(r.id, r.block, r.least) for r in top[:offered]], "id long, block long, least double")
        found = sorted(held.where(F.col("block").isin(sorted({r.block for r in top[:offered]}))).join(F.broadcast(chosen), ["block", "id"]).select("id", "v", "least").collect())
        v, left = np.array([r.v for r in found], float), np.array([r.least for r in found])
        taken: list[int] = []
        while len(ids) + len(taken) < target and (not taken or left.max() > below):
            taken.append(int(left.argmax()))
            left = np.minimum(left, ((v - v[taken[-1]]) ** 2).sum(1))
        ids += [found[at].id for at in taken]
        new = v[taken]
    picks = spark.createDataFrame(list(enumerate(ids)), "pick int, id long")  # as many as the coreset has rows
    return picks.join(rows, "id").select("id", "v", "pick")


def _block_reach(pivots: np.ndarray):
    def run(frames):
        for pdf in frames:
            v, b = np.array(pdf["v"].tolist(), float).reshape(len(pdf), pivots.shape[1]), pdf["block"].to_numpy()
            yield pd.DataFrame({"block": b, "far": np.sqrt(((v - pivots[b]) ** 2).sum(1))}).groupby("block", as_index=False).max()

    return run
