"""A store of models: each table partitioned by model and version, and a manifest that is written last.

A version counts once its row is in the manifest, so that a fit that fails leaves the one before in use. Fits of
different models don't touch each other's folders.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "model string, version long, tables array<string>"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """model, version, tables: the version in use of each model."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:  # nothing is stored yet
        return spark.createDataFrame([], MANIFEST)
    return rows.groupBy("model").agg(F.max_by(F.struct("version", "tables"), "version").alias("v")).select("model", "v.version", "v.tables")


def save(root: str, tables: dict[str, DataFrame], model: str) -> int:
    """Write the tables of one model (bank, statistics, masks) as its next version, then put that in use; returns the version."""
    if not re.fullmatch(r"[\w.-]+", model):
        raise ValueError("a model's name is made of letters, digits, _ . -")
    spark = next(iter(tables.values())).sparkSession
    last = versions(spark, root).where(F.col("model") == model).first()
    version = last.version + 1 if last else 1
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{root}/{name}/model={model}/version={version}")
    row = spark.createDataFrame([(model, version, list(tables))], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return version


def load(spark: SparkSession, root: str, name: str, model: str) -> DataFrame:
    """A table of one model in use; only its own folder is listed."""
    found = versions(spark, root).where(F.col("model") == model).first()
    if found is None or name not in found.tables:
        raise KeyError(f"no {name} of {model}")
    return spark.read.option("basePath", f"{root}/{name}").parquet(f"{root}/{name}/model={model}/version={found.version}").withColumn("model", F.lit(model)).drop("version")


def load_all(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all models in use, versions before left out by a join on the partitions."""
    rows = spark.read.parquet(f"{root}/{name}").withColumn("model", F.col("model").cast("string"))
    return rows.join(F.broadcast(versions(spark, root).where(F.array_contains("tables", name)).select("model", "version")), ["model", "version"]).drop("version")
