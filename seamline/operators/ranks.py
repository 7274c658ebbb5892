"""Exact ranks and percentiles of groups of any size.

Percentiles are bracketed by approximate quantiles, whose error has a bound, so that only the values in a narrow bracket are sorted.
Ranks run within ranges of value and tie, as many as the rows need, and start from the counts of the ranges below.
No window or aggregate holds a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.plans.lineage import cut

#: Rows of a range that one task ranks.
ROWS = 1_000_000
#: Approximate quantiles are off by 2 / ACCURACY of a group's rows at most; brackets reach twice as far.
ACCURACY = 10_000


def ranked(rows: DataFrame, keys: list[str], value: str, tie: list[str], part_rows: int = ROWS) -> DataFrame:
    """Add rank (from 0, by ``value`` then ``tie``) and n (rows of the group). Values are not null.

    Beyond ``part_rows`` rows are dealt by ranges of value and tie, so that equal values are parted too, and cut there.
    """
    parts = max(1, -(-rows.count() // part_rows))
    dealt = cut(rows.repartitionByRange(parts, value, *tie).withColumn("_part", F.spark_partition_id())) if parts > 1 else rows.withColumn("_part", F.lit(0))
    below = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    starts = counts.select(*keys, "_part", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_below"), F.sum("_c").over(Window.partitionBy(*keys)).alias("n"))
    inside = Window.partitionBy(*keys, "_part").orderBy(value, *tie)
    out = dealt.withColumn("_at", F.row_number().over(inside) - 1).join(starts, [*keys, "_part"])
    return out.withColumn("rank", F.col("_below") + F.col("_at")).drop("_part", "_below", "_at")


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """keys and, by name, percentiles of ``value`` at each share, linear between neighbours. Nulls don't count.

    A bracket of approximate quantiles about each share holds its neighbours for sure. Rows below a bracket are counted, and its
    values, equal ones once, are summed in order. All shares are worked out together. Keys are not null.
    """
    names = list(shares)
    given = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    reach = 4 / accuracy
    ends = F.array(*[F.lit(min(1.0, max(0.0, shares[n] + d))) for n in names for d in (-reach, reach)])
    about = given.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.percentile_approx("_v", ends, accuracy).alias("_q"))
    # a group of few rows is its own bracket
    low = lambda i: F.when((F.col("_n") < accuracy) | (shares[names[i]] <= reach), F.col("_min")).otherwise(F.get("_q", F.lit(2 * i)))
    high = lambda i: F.when((F.col("_n") < accuracy) | (shares[names[i]] >= 1 - reach), F.col("_max")).otherwise(F.get("_q", F.lit(2 * i + 1)))
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(shares[n])).alias("p"), low(i).alias("low"), high(i).alias("high")) for i, n in enumerate(names)])
    bounds = about.select(*keys, "_n", F.explode(brackets).alias("b"))
    joined = given.join(bounds, keys) if keys else given.crossJoin(F.broadcast(bounds))  # without keys, a row a share
    held = F.when(F.col("_v").between(F.col("b.low"), F.col("b.high")), F.col("_v"))
    counts = joined.where(F.col("_v") <= F.col("b.high")).groupBy(*keys, "_n", F.col("b.i").alias("_i"), F.col("b.p").alias("_p"), held.alias("_at")).agg(F.count(F.lit(1)).alias("_c"))
    run = counts.withColumn("_last", F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_at"))))
    first = F.col("_last") - F.col("_c")
    place = (F.col("_n") - 1) * F.col("_p")
    at = lambda x: F.max(F.when((first <= x) & (x < F.col("_last")), F.col("_at")))
    both = run.groupBy(*keys, "_i").agg(at(F.floor(place)).alias("_low"), at(F.ceil(place)).alias("_high"), F.max(place - F.floor(place)).alias("_part"))
    value_of = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
    return both.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, value_of)).alias(n) for i, n in enumerate(names)])
