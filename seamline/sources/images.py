"""Image stores as tables: listings, inventories, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.functions.names import natural_key, parse_spec, prod_date, spec_key
from seamline.operators.catalog import numbered

TYPES = ["jpg", "jpeg", "png", "bmp"]


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, cam_id, file, size of all images under root/[date/]folder/camera_n/, contents unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"))
    part = lambda i: F.regexp_extract("path", r"([^/]+)/camera_(\d+)/([^/]+)$", i)
    out = files.select("path", part(1).alias("folder"), part(2).cast("int").alias("cam_id"), part(3).alias("file"), "size")
    return out.where(F.lower(F.regexp_extract("file", r"\.([^.]+)$", 1)).isin(TYPES))


def folders(images: DataFrame) -> DataFrame:
    """name, raw_spec, width_mm, height_mm, spec_key, prod_date of folders that have a camera_1 and a spec."""
    valid = images.where("cam_id = 1").select("folder").distinct()
    names = images.select("folder").distinct().join(valid, "folder", "left_semi")
    parsed = names.select(F.col("folder").alias("name"), parse_spec(F.col("folder")).alias("s"), prod_date(F.col("folder")).alias("prod_date")).where("s is not null")
    return parsed.select("name", "s.*", spec_key(F.col("s.raw_spec")).alias("spec_key"), "prod_date")


def ordered(images: DataFrame) -> DataFrame:
    """Images with img_idx from 0 in natural order of file names within folder and camera."""
    return numbered(images, ["folder", "cam_id"], [natural_key(F.col("file")), F.col("file")]).withColumn("img_idx", F.col("rn") - 1).drop("n", "rn")


def inventory(images: DataFrame, cameras: int = 10) -> DataFrame:
    """folder, cam_1 .. cam_n image counts, total."""
    wide = images.groupBy("folder").pivot("cam_id", list(range(1, cameras + 1))).count()
    counts = [F.coalesce(F.col(str(i)), F.lit(0)).alias(f"cam_{i}") for i in range(1, cameras + 1)]
    return wide.select("folder", *counts).withColumn("total", sum((F.col(f"cam_{i}") for i in range(1, cameras + 1)), F.lit(0)))


def unfinished(jobs: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs without a finished output."""
    return jobs.join(finished, keys, "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, columns: list[str], path: str) -> None:
    """Text lines of tab-joined columns, in order."""
    df.orderBy(*columns).select(F.concat_ws("\t", *columns).alias("value")).write.mode("overwrite").text(path)
