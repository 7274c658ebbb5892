"""Catalogues of folders and images: trims, strides, quotas, splits, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(images: DataFrame, group: list[str], order: list) -> DataFrame:
    """Add n (rows of the group) and rn (from 1, in order)."""
    by = Window.partitionBy(*group)
    return images.withColumn("n", F.count(F.lit(1)).over(by)).withColumn("rn", F.row_number().over(by.orderBy(*order)))


def trim_stride(images: DataFrame, group: list[str], order: list, head: int, tail: int, step: int = 1, offset: int = 0) -> DataFrame:
    """Drop ``head`` first and ``tail`` last images of each group (all of one no longer than both), keep every step-th from ``offset``."""
    at = F.col("rn") - 1 - head
    return numbered(images, group, order).where((F.col("n") > head + tail) & (at >= 0) & (F.col("rn") <= F.col("n") - tail) & (F.pmod(at, F.lit(step)) == offset)).drop("n", "rn")


def cap_even(images: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    """At most ``cap`` images of each group, evenly strided."""
    step = F.greatest(F.floor(F.col("n") / cap), F.lit(1))
    at = F.col("rn") - 1
    return numbered(images, group, order).where((F.pmod(at, step) == 0) & (F.floor(at / step) < cap)).drop("n", "rn")


def first_n(images: DataFrame, group: list[str], order: list, n: int) -> DataFrame:
    return numbered(images, group, order).where(F.col("rn") <= n).drop("n", "rn")


def picks(images: DataFrame, group: list[str], order: list) -> DataFrame:
    """The images at ranks 0, n/4 and n/2 of each group."""
    at = F.col("rn") - 1
    return numbered(images, group, order).where((at == 0) | (at == F.floor(F.col("n") / 4)) | (at == F.floor(F.col("n") / 2))).drop("n").withColumn("rank", at.cast("int")).drop("rn")


def stratified(folders: DataFrame, most: int, key: str = "name", date: str = "prod_date") -> DataFrame:
    """Up to ``most`` folders in equal quotas by date, one more for the first dates, rest filled from dates with more.

    Within a date, and for the rest, folders are taken in order of md5 of their key.
    """
    from seamline.plans.lineage import cut

    rows = cut(folders)  # parsed once for the counts by date and for the ranking
    sizes = {r[0]: r[1] for r in rows.groupBy(date).count().collect()}  # one a date
    if sum(sizes.values()) <= most:
        return rows
    dates = sorted(sizes, key=lambda d: (d is not None, d if d is not None else ""))
    quota = {d: most // len(dates) + (i < most % len(dates)) for i, d in enumerate(dates)}
    short = most - sum(min(quota[d], n) for d, n in sizes.items())
    quotas = rows.sparkSession.createDataFrame(list(quota.items()), rows.select(F.col(date).alias("q_date"), F.lit(0).alias("quota")).schema)
    order = [F.md5(F.col(key).cast("binary")), F.col(key)]
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy(date).orderBy(*order))).join(F.broadcast(quotas), F.col(date).eqNullSafe(F.col("q_date")))
    taken, rest = placed.where("rn <= quota"), placed.where("rn > quota").orderBy(*order).limit(max(short, 0))
    return taken.union(rest).select(*folders.columns)


def adaptive_step(folders: int, cams: int, target: int, images: int = 700) -> int:
    """Stride that leaves about ``target`` images of ``folders`` folders."""
    return max(1, round(folders * cams * images / target))


def latest_split(rows: DataFrame, date: str, latest: int) -> DataFrame:
    """Add split: test for the ``latest`` newest dates, else train."""
    newest = rows.select(date).distinct().orderBy(F.desc(date)).limit(latest).agg(F.min(date).alias("from"))
    return rows.join(F.broadcast(newest)).withColumn("split", F.when(F.col(date) >= F.col("from"), "test").otherwise("train")).drop("from")


def plan(specs: DataFrame, groups: int, finished: DataFrame, priority: Column) -> DataFrame:
    """Jobs spec x group with status EXISTS or TODO, and the priority by which to take them. ``finished``: spec_key, group_id."""
    jobs = specs.withColumn("group_id", F.explode(F.sequence(F.lit(1), F.lit(groups))))
    done = finished.select("spec_key", "group_id").distinct().withColumn("done", F.lit(True))
    return jobs.join(done, ["spec_key", "group_id"], "left").withColumn("status", F.when(F.col("done"), "EXISTS").otherwise("TODO")).withColumn("priority", priority).drop("done")


def three_tier(rows: DataFrame, group: list[str], tier: Column, key: str, n: int) -> DataFrame:
    """Up to ``n`` rows of each group, lower tiers first (1 unused, 2 trimmed, 3 between strides; null: never), by md5 of the key within one."""
    order = [F.col("tier"), F.md5(F.col(key).cast("string").cast("binary")), F.col(key)]
    ranked = rows.withColumn("tier", tier).where("tier is not null")
    return ranked.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n).drop("rn")


def paired_strips(means: DataFrame) -> DataFrame:
    """cam_id, strip, gap between each camera of a pair and its mirror. ``means``: cam_id 1 to 10, strip 0 to 9, mean."""
    other = means.select((11 - F.col("cam_id")).alias("cam_id"), (9 - F.col("strip")).alias("strip"), F.col("mean").alias("mirror"))
    return means.where("cam_id <= 5").join(other, ["cam_id", "strip"]).select("cam_id", "strip", F.abs(F.col("mean") - F.col("mirror")).alias("gap"))


def defect_split(folders: DataFrame, pattern: str, mark: str) -> DataFrame:
    """Folders whose name has ``pattern``, with is_defect where it also has ``mark``."""
    return folders.where(F.contains("name", F.lit(pattern))).withColumn("is_defect", F.contains("name", F.lit(mark)))


def date_policy(folders: DataFrame, policy: str, every: int = 5, date: str = "prod_date", key: str = "name") -> DataFrame:
    """Normal folders to train on. drop: none of a date with a defect folder; keep: all; sparse: of such dates every ``every``-th, by md5 of the key."""
    normal = folders.where(~F.col("is_defect"))
    if policy == "keep":
        return normal
    spoilt = folders.where("is_defect").select(date).distinct()
    if policy == "drop":
        return normal.join(spoilt, date, "left_anti").select(*folders.columns)
    if policy != "sparse":
        raise ValueError(f"no policy {policy}")
    by = Window.partitionBy(date).orderBy(F.md5(F.col(key).cast("binary")), F.col(key))
    thin = normal.join(spoilt.withColumn("spoilt", F.lit(True)), date, "left").withColumn("rn", F.row_number().over(by))
    return thin.where("spoilt is null or (rn - 1) % %d = 0".replace("%d", str(every))).select(*folders.columns)


def camera_dimension(spark) -> DataFrame:
    """cam_id, group_id, is_mirror of the ten cameras."""
    from seamline.functions.names import camera_group, mirrored

    cams = spark.range(1, 11).select(F.col("id").cast("int").alias("cam_id"))
    return cams.select("cam_id", camera_group(F.col("cam_id")).cast("int").alias("group_id"), mirrored(F.col("cam_id")).alias("is_mirror"))


def manifest(images: DataFrame, group: list[str], key: str, n: int, target: str) -> DataFrame:
    """The first ``n`` images of each group by md5 of their key, with the path that a copy would have."""
    by = Window.partitionBy(*group).orderBy(F.md5(F.col(key).cast("string").cast("binary")), F.col(key))
    place = F.concat_ws("/", F.lit(target), *[F.col(c).cast("string") for c in group], F.concat(F.lpad(F.col("rn").cast("string"), 3, "0"), F.lit("_"), F.col(key).cast("string")))
    return images.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= n).withColumn("copy_to", place).drop("rn")
