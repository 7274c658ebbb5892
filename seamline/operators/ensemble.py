"""Combining an image's metrics or methods into one decision. Long input: image_id, metric, value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def long(wide: DataFrame, metrics: list[str]) -> DataFrame:
    return wide.unpivot("image_id", metrics, "metric", "value")


def standardised(values: DataFrame, normal: DataFrame, floor: float = 1e-6) -> DataFrame:
    """values with z by each metric's mean and deviation over the normal images."""
    stats = normal.groupBy("metric").agg(F.avg("value").alias("mean"), F.greatest(F.stddev_pop("value"), F.lit(floor)).alias("std"))
    return values.join(stats, "metric").withColumn("z", (F.col("value") - F.col("mean")) / F.col("std")).drop("mean", "std")


def ens_max_z(z: DataFrame, metrics: list[str], threshold: float = 3.0) -> DataFrame:
    """image_id, ens_max, dominant_metric (ties: earlier in ``metrics``), anomaly."""
    place = F.array_position(F.array(*[F.lit(m) for m in metrics]), F.col("metric"))
    best = Window.partitionBy("image_id").orderBy(F.desc("z"), place)
    top = z.withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return top.select("image_id", F.col("z").alias("ens_max"), F.col("metric").alias("dominant_metric"), (F.col("z") > threshold).alias("anomaly"))


def ens_top(z: DataFrame, k: int | None = 3) -> DataFrame:
    """image_id, ens: mean of the k highest z (None: of all)."""
    if k is not None:
        best = Window.partitionBy("image_id").orderBy(F.desc("z"), "metric")
        z = z.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)
    return z.groupBy("image_id").agg(F.avg("z").alias("ens"))


def ens_or_ratio(values: DataFrame, normal: DataFrame, threshold: float = 1.1) -> DataFrame:
    """image_id, any_over, max_ratio: ratios of values to the metric's normal mean."""
    stats = normal.groupBy("metric").agg(F.avg("value").alias("mean"))
    ratio = F.when(F.col("mean") > 0, F.col("value") / F.col("mean")).otherwise(F.col("value"))
    return values.join(stats, "metric").withColumn("ratio", ratio).groupBy("image_id").agg(F.bool_or(F.col("ratio") > threshold).alias("any_over"), F.max("ratio").alias("max_ratio"))


def ens_weighted(z: DataFrame, weights: dict[str, float]) -> DataFrame:
    """image_id, ens: weighted sum of z."""
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return z.groupBy("image_id").agg(F.sum(F.coalesce(F.try_element_at(weight, F.col("metric")), F.lit(0.0)) * F.col("z")).alias("ens"))


def subsets(z: DataFrame, members: dict[str, list[str]], thresholds: list[float]) -> DataFrame:
    """subset, threshold, n_images, n_over: images whose highest z within the subset of metrics is over each threshold."""
    of = {m: [n for n, ms in members.items() if m in ms] for ms in members.values() for m in ms}
    lists = F.create_map(*[x for m, ns in of.items() for x in (F.lit(m), F.array(*[F.lit(n) for n in ns]))])
    best = z.select("image_id", "z", F.explode(F.try_element_at(lists, F.col("metric"))).alias("subset")).groupBy("subset", "image_id").agg(F.max("z").alias("z"))
    grid = best.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return grid.groupBy("subset", "threshold").agg(F.count(F.lit(1)).alias("n_images"), F.sum((F.col("z") > F.col("threshold")).cast("long")).alias("n_over"))


def adaptive(scores: DataFrame, normal: DataFrame, threshold: float) -> DataFrame:
    """scores with z by their method's own normal scores (method, score), and detected."""
    stats = normal.groupBy("method").agg(F.avg("score").alias("mean"), F.greatest(F.stddev_pop("score"), F.lit(1e-6)).alias("std"))
    z = (F.col("score") - F.col("mean")) / F.col("std")
    return scores.join(stats, "method").withColumn("z", z).withColumn("detected", F.col("z") > threshold).drop("mean", "std")


def search(z: DataFrame, keys: list[str], members: dict[str, list[str]], top: int = 2) -> DataFrame:
    """keys, subset, agg, image_id, score: each subset of metrics combined by max, mean and mean of the ``top`` highest z.

    ``z``: keys, image_id, metric, z. Rows are multiplied by the subsets that a metric is in, and no further.
    """
    of = {m: [n for n, ms in members.items() if m in ms] for ms in members.values() for m in ms}
    lists = F.create_map(*[x for m, ns in of.items() for x in (F.lit(m), F.array(*[F.lit(n) for n in ns]))])
    each = z.select(*keys, "image_id", "z", F.explode(F.try_element_at(lists, F.col("metric"))).alias("subset")).groupBy(*keys, "subset", "image_id").agg(F.sort_array(F.collect_list("z"), asc=False).alias("zs"))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x) / F.size(a)
    return each.select(*keys, "subset", "image_id", F.explode(F.create_map(F.lit("max"), F.get("zs", F.lit(0)), F.lit("mean"), mean(F.col("zs")), F.lit("top"), mean(F.slice("zs", 1, top)))).alias("agg", "score"))
