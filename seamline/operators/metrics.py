"""Position statistics and image metrics over tile scores (image_id, pos, score)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions.stats import zscore

#: Names and order of the metrics.
METRICS = ["tile_max_raw", "tile_mean_raw", "tile_p95_raw", "tile_max_z", "tile_mean_z", "tile_p95_z", "anomaly_count", "cluster_score", "max_vertical_run", "z_skewness", "z_kurtosis"]


def position_stats(scores: DataFrame, floor_many: float = 0.01, floor_few: float = 0.1, many: int = 10) -> DataFrame:
    """pos, n, mean, std over images; the floor of std depends on how many images there are."""
    floor = F.when(F.count("score") >= many, floor_many).otherwise(floor_few)
    return scores.groupBy("pos").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.greatest(F.stddev_pop("score"), floor).alias("std"))


def position_z(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """Scores with z by the statistics of their position."""
    return scores.join(stats.select("pos", "mean", "std"), "pos").withColumn("z", zscore(F.col("score"), F.col("mean"), F.col("std"), 0.0)).drop("mean", "std")


def rollup(scores: DataFrame) -> DataFrame:
    """image_id, n_tiles, max_score, mean_score."""
    return scores.groupBy("image_id").agg(F.count("score").alias("n_tiles"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def top_mean(scores: DataFrame, k: int = 3) -> DataFrame:
    """image_id, top_mean: mean of the k highest scores."""
    best = Window.partitionBy("image_id").orderBy(F.desc("score"), "pos")
    return scores.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).groupBy("image_id").agg(F.avg("score").alias("top_mean"))


def vertical_run(cells: DataFrame, threshold: float) -> DataFrame:
    """image_id, max_vertical_run: most cells in a column in a row with z over the threshold. ``cells``: image_id, row, col, z."""
    hot = cells.where(F.col("z") > threshold)
    island = F.col("row") - F.row_number().over(Window.partitionBy("image_id", "col").orderBy("row"))
    runs = hot.withColumn("island", island).groupBy("image_id", "col", "island").count()
    return runs.groupBy("image_id").agg(F.max("count").alias("max_vertical_run"))


def cluster_sizes(cells: set[tuple[int, int]]) -> list[int]:
    """Sizes of 4-neighbour components."""
    left, sizes = set(cells), []
    while left:
        stack, n = [left.pop()], 0
        while stack:
            r, c = stack.pop()
            n += 1
            for x in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if x in left:
                    left.remove(x)
                    stack.append(x)
        sizes.append(n)
    return sizes


def _clusters(pdf: pd.DataFrame) -> pd.DataFrame:
    sizes = cluster_sizes(set(zip(pdf["row"], pdf["col"], strict=True)))
    return pd.DataFrame({"image_id": [pdf["image_id"].iloc[0]], "largest": [max(sizes)], "cluster_score": [float(np.sqrt(max(sizes) * sum(sizes)))]})


def cluster_score(cells: DataFrame, threshold: float) -> DataFrame:
    """image_id, largest, cluster_score = sqrt(largest * all) over cells with z over the threshold. One image's grid is one group."""
    return cells.where(F.col("z") > threshold).select("image_id", "row", "col").groupBy("image_id").applyInPandas(_clusters, "image_id long, largest long, cluster_score double")


def image_metrics(cells: DataFrame, threshold: float) -> DataFrame:
    """image_id and the eleven METRICS; an image without valid scores has zeros. ``cells``: image_id, row, col, score, z."""
    p95 = lambda c: F.percentile(c, F.lit(0.95))
    shaped = lambda f: F.when(F.count("z") > 3, f("z")).otherwise(0.0)
    base = cells.groupBy("image_id").agg(F.max("score").alias("tile_max_raw"), F.avg("score").alias("tile_mean_raw"), p95("score").alias("tile_p95_raw"), F.max("z").alias("tile_max_z"), F.avg("z").alias("tile_mean_z"), p95("z").alias("tile_p95_z"), F.sum((F.col("z") > threshold).cast("double")).alias("anomaly_count"), shaped(F.skewness).alias("z_skewness"), shaped(F.kurtosis).alias("z_kurtosis"))
    out = base.join(cluster_score(cells, threshold), "image_id", "left").join(vertical_run(cells, threshold), "image_id", "left")
    return out.select("image_id", *[F.coalesce(F.nanvl(F.col(m).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(m) for m in METRICS])
