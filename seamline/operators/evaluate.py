"""Evaluating detectors over rows of (score double, label boolean)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.functions.stats import bin_of, percent

from .ranks import percentiles


def sweep(rows: DataFrame, thresholds: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, threshold, tp, fp, fn, tn, precision, recall, f1, fpr of score > threshold; 0 where undefined.

    Rows are first counted by the step of the grid they fall in, so that they aren't multiplied by it.
    """
    keys = keys or []
    grid = sorted(float(t) for t in thresholds)
    over = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: t < F.col("score")))
    counts = rows.withColumn("over", over).groupBy(*keys, "over", "label").count()
    each = counts.select("*", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("at", "threshold"))
    n = lambda hit, label: F.coalesce(F.sum(F.when((F.col("over") > F.col("at") if hit else F.col("over") <= F.col("at")) & (F.col("label") if label else ~F.col("label")), F.col("count"))), F.lit(0))
    out = each.groupBy(*keys, "threshold").agg(n(True, True).alias("tp"), n(True, False).alias("fp"), n(False, True).alias("fn"), n(False, False).alias("tn"))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumn("precision", share(tp, tp + fp)).withColumn("recall", share(tp, tp + fn)).withColumn("f1", share(2 * tp, 2 * tp + fp + fn)).withColumn("fpr", share(fp, fp + tn))


def best_f1(table: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The row of highest F1, ties to the lower threshold."""
    return _first(table, keys, [F.desc("f1"), F.col("threshold")])


def best_within_fpr(table: DataFrame, fpr: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """The row of highest recall with a false-positive rate of ``fpr`` at most, ties to the lower threshold."""
    return _first(table.where(F.col("fpr") <= fpr), keys, [F.desc("recall"), F.col("threshold")])


def _first(table: DataFrame, keys: list[str] | None, order: list) -> DataFrame:
    if not keys:
        return table.orderBy(*order).limit(1)
    return table.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn = 1").drop("rn")


def cumulative(rows: DataFrame, keys: list[str] | None = None, parts: int = 64) -> DataFrame:
    """keys, score, pos, neg, pos_above, neg_above: by distinct score, counts at it and strictly above it.

    Scores are dealt into ranges by approximate quantiles; sums run within a range and start from
    the sums of the ranges above, so that no window holds all scores.
    """
    keys = keys or []
    counts = rows.groupBy(*keys, "score").agg(F.sum(F.col("label").cast("long")).alias("pos"), F.sum((~F.col("label")).cast("long")).alias("neg"))
    cuts = sorted(set(rows.approxQuantile("score", [i / parts for i in range(1, parts)], 0.005)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    counts = counts.withColumn("part", part)
    above = Window.partitionBy(*keys).orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    starts = totals.select(*keys, "part", F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n0"))
    inside = Window.partitionBy(*keys, "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    run = counts.withColumn("pi", F.coalesce(F.sum("pos").over(inside), F.lit(0))).withColumn("ni", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    return run.join(starts, [*keys, "part"]).select(*keys, "score", "pos", "neg", (F.col("p0") + F.col("pi")).alias("pos_above"), (F.col("n0") + F.col("ni")).alias("neg_above"))


def auroc(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, n_pos, n_neg, auroc with ties counted half; 0 where one class is missing."""
    keys = keys or []
    won = F.sum(F.col("neg").cast("double") * (F.col("pos_above") + F.col("pos") / 2))
    out = cumulative(rows, keys).groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("won"))
    return out.select(*keys, "n_pos", "n_neg", F.coalesce(F.try_divide(F.col("won"), F.col("n_pos").cast("double") * F.col("n_neg")), F.lit(0.0)).alias("auroc"))


def pr_best_f1(rows: DataFrame) -> DataFrame:
    """threshold, precision, recall, f1 of the best score >= threshold over all distinct scores; ties to the higher one."""
    c = cumulative(rows)
    total = c.agg(F.sum("pos").alias("total"))
    tp, fp = (F.col("pos_above") + F.col("pos")).cast("double"), (F.col("neg_above") + F.col("neg")).cast("double")
    out = c.join(F.broadcast(total)).select(F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"), (tp / F.col("total")).alias("recall"))
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8)
    return out.withColumn("f1", f1).orderBy(F.desc("f1"), F.desc("threshold")).limit(1)


def at_percentiles(rows: DataFrame, percents: list[float]) -> DataFrame:
    """percentile, threshold (of normal scores), detect_pct: share of defects above it."""
    names = {f"p{i}": p / 100 for i, p in enumerate(percents)}
    normal = percentiles(rows.where(~F.col("label")), [], "score", names)
    cuts = normal.select(F.posexplode(F.array(*names)).alias("at", "threshold"))
    defects = rows.where("label").join(F.broadcast(cuts))
    hit = defects.groupBy("at", "threshold").agg(percent(F.sum((F.col("score") > F.col("threshold")).cast("long")), F.count(F.lit(1))).alias("detect_pct"))
    return hit.select(F.element_at(F.array(*[F.lit(float(p)) for p in percents]), F.col("at") + 1).alias("percentile"), "threshold", "detect_pct")


def histogram(rows: DataFrame, bins: int, keys: list[str] | None = None) -> DataFrame:
    """keys, bin, n over equal widths of each key's range."""
    keys = keys or []
    span = rows.groupBy(*keys).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    joined = rows.join(F.broadcast(span)) if not keys else rows.join(span, keys)
    return joined.groupBy(*keys, bin_of(F.col("score"), F.col("low"), F.col("high"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def rate_cube(facts: DataFrame, dims: list[str]) -> DataFrame:
    """dims, n, n_detected, rate for each single dimension, all of them together, and the total (grouping sets)."""
    sets = ", ".join([*(f"({d})" for d in dims), f"({', '.join(dims)})", "()"])
    text = f"SELECT {', '.join(dims)}, count(*) AS n, count_if(detected) AS n_detected, 100D * count_if(detected) / count(*) AS rate FROM {{facts}} GROUP BY GROUPING SETS ({sets})"
    return facts.sparkSession.sql(text, facts=facts)


def overfit_gap(pairs: DataFrame) -> DataFrame:
    """gap_pct of the mean scores by the same bank and by a fair one. ``pairs``: same, fair."""
    return pairs.agg((F.abs(F.avg("same") - F.avg("fair")) / F.greatest(F.avg("fair"), F.lit(1e-6)) * 100).alias("gap_pct"))


def paired(facts: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """keys, score_a, score_b, hit_a, hit_b of two methods where both have a row. ``facts``: keys, method, score, detected."""
    one = lambda m, s: facts.where(F.col("method") == m).select(*keys, F.col("score").alias(f"score_{s}"), F.col("detected").alias(f"hit_{s}"))
    return one(first, "a").join(one(second, "b"), keys)


def against_own_normal(defects: DataFrame, normal: DataFrame, keys: list[str]) -> DataFrame:
    """Defect scores with the ratio to the clean score of the same tile (null where that isn't positive)."""
    clean = normal.groupBy(*keys).agg(F.avg("score").alias("clean"))
    return defects.join(clean, keys).withColumn("ratio", F.when(F.col("clean") > 0, F.col("score") / F.col("clean")))


def median_separation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, separation: median score of defects less that of normal rows, where a key has both."""
    m = percentiles(rows, [*keys, "label"], "score", {"m": 0.5})
    return m.groupBy(*keys).agg((F.max(F.when(F.col("label"), F.col("m"))) - F.max(F.when(~F.col("label"), F.col("m")))).alias("separation")).where("separation is not null")
