"""Scoring a stream of vectors against a bank, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seamline.operators import knn


def score_stream(vectors: DataFrame, bank: DataFrame, threshold: float, path: str, checkpoint: str, k: int = 1) -> StreamingQuery:
    """Write id, score, anomaly of a stream (id, v) as Parquet under ``path``/batch=n; a repeated batch replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        scored = knn.scores(batch, bank, k).withColumn("anomaly", F.col("score") > threshold)
        scored.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return vectors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
