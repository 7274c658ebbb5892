"""Helpers shared by the training-data operators: reading, lineage cuts, dense numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.plans.lineage import cut, own_folder  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; the path may be in any store that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to a new path of the shared folder and read again: a cut whose columns can be read apart."""
    path = own_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame of ``written`` that nothing reads any more.

    The driver's memory is collected then, so that Spark also deletes the shuffles of finished plans, which else lie on the disks until it happens to be.
    """
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark._jvm.java.lang.System.gc()


#: Bytes of a batch that Spark sends to Python. Counted by rows alone, as many as 10,000 long texts would make one.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> None:
    """Hold Arrow batches of the session to BATCH_BYTES (a longer row stands alone), unless the session has a value of its own.

    The setting stays, for later jobs of the session too: a lazy plan reads it when it runs.
    """
    conf = df.sparkSession.conf
    unset = "1b"  # a valid size that nobody sets
    if conf.get(_BATCH_SETTING, unset) == unset:
        conf.set(_BATCH_SETTING, BATCH_BYTES)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, so that extra columns can't clash."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"{name}_"
    return name


def bucket_of(key: Column, buckets: int) -> Column:
    """Bucket of a signed 64-bit hash, equal ranges of hash values."""
    return F.pmod(F.shiftrightunsigned(key, 16), F.lit(buckets)).cast("long")


def dense_positions(df: DataFrame, group: str, tie: list[str], rows: int, bucket_rows: int = 4_000, out: str = "pos") -> DataFrame:
    """Number the rows of each group from 0 without gaps, in an order fixed by a hash of ``tie``.

    No group meets in one task: rows are ordered within hash buckets of about
    ``bucket_rows`` rows, and a bucket starts where the counts of the buckets before it end.
    ``rows`` is the row count, from which the number of buckets follows. Equal rows are
    interchangeable, so that their order may differ between runs. ``group`` has no nulls, so that counts
    join by the partitioning that the numbering has.
    """
    buckets = max(1, -(-rows // bucket_rows))
    df = df.withColumn("_h", F.xxhash64(*tie)).withColumn("_b", bucket_of(F.col("_h"), buckets))
    counts = df.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy(group, "_b").orderBy("_h", *tie)
    numbered = df.withColumn("_r", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(offsets, [group, "_b"]).withColumn(out, F.col("_first") + F.col("_r")).drop("_h", "_b", "_first", "_r")
