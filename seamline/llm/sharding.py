"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. A partial partition is one sum a shard; the two with the
largest spread are combined, one in falling and one in rising order, until a single one is left.
The operation takes partial partitions as well as single groups, so blocks of groups are combined
in parallel, then the blocks' results in turn, some thousands at a time.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, cut, dense_positions, table

SHARDS = 24
OVERHEAD = 8
#: Partial partitions that one task combines.
FAN_IN = 4096


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine the rows of ``parts`` (n partial partitions by shards).

    Returns the n by shards table of where each part of each row goes, and the sums of the result.
    """
    n, k = parts.shape
    nodes = list(parts)
    joins: list[tuple[int, np.ndarray, int, np.ndarray]] = []
    heap = [(-int(p.max() - p.min()), i) for i, p in enumerate(nodes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        down, up = np.argsort(-nodes[a], kind="stable"), np.argsort(nodes[b], kind="stable")
        joins.append((a, down, b, up))
        nodes.append(nodes[a][down] + nodes[b][up])
        heapq.heappush(heap, (-int(nodes[-1].max() - nodes[-1].min()), len(nodes) - 1))
    goes = np.empty((len(nodes), k), np.int64)
    goes[-1] = np.arange(k)
    for i in range(len(joins) - 1, -1, -1):
        a, down, b, up = joins[i]
        goes[a][down] = goes[n + i]
        goes[b][up] = goes[n + i]
    return goes[:n], nodes[-1]


def _leaves(shards: int):
    def combine(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "digest"], ascending=[False, True])
        parts = np.zeros((len(pdf), shards), np.int64)
        parts[:, 0] = pdf["bytes"]
        goes, sums = difference(parts)
        return pd.DataFrame({"block": key[0], "digest": pdf["digest"].to_numpy(), "part": goes[:, 0], "sums": [sums.tolist()] + [None] * (len(pdf) - 1)})

    return combine


def _inner(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("block")
    goes, sums = difference(np.array(pdf["sums"].tolist(), np.int64))
    return pd.DataFrame({"block": pdf["block"].to_numpy(), "above": key[0], "goes": goes.tolist(), "sums": [sums.tolist()] + [None] * (len(pdf) - 1)})


def balance(groups: DataFrame, shards: int, n_groups: int, fan_in: int = FAN_IN) -> DataFrame:
    """(digest, bytes) to (digest, shard): near equal bytes a shard. ``n_groups`` is the row count."""
    blocks = max(1, -(-n_groups // fan_in))
    leaves = groups.withColumn("block", bucket_of(F.xxhash64("digest"), blocks)).groupBy("block").applyInPandas(_leaves(shards), "block long, digest binary, part long, sums array<long>")
    leaves = cut(leaves)
    level = leaves.where("sums is not null").select("block", "sums")
    paths = leaves.where("sums is not null").select("block", F.col("block").alias("top"), F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>").alias("goes"))
    while blocks > 1:
        level = cut(level.withColumn("above", F.expr(f"block div {fan_in}")).groupBy("above").applyInPandas(_inner, "block long, above long, goes array<long>, sums array<long>"))
        step = level.select(F.col("block").alias("top"), "above", F.col("goes").alias("then"))
        paths = paths.join(step, "top").select("block", F.col("above").alias("top"), F.transform("goes", lambda x: F.element_at("then", (x + 1).cast("int"))).alias("goes"))
        level = level.where("sums is not null").select(F.col("above").alias("block"), "sums")
        blocks = -(-blocks // fan_in)
    return leaves.select("digest", "block", "part").join(paths.select("block", "goes"), "block").select("digest", F.element_at("goes", (F.col("part") + 1).cast("int")).cast("int").alias("shard"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """One row for each of ``docs``: id, size, text_crc32, shard and slot (from 0 without gaps in each shard).

    Equal texts share a shard; null texts are one group of their own with no text bytes and the CRC
    of no bytes, empty texts another. Repeated rows are placed each. Sizes near equal: a shard holds
    more than its share only where one group of equal texts does. Empty input gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), F.coalesce(F.unhex(F.sha2(text_col, 256)), F.lit(b"\0")).alias("digest"))
    rows = cut(rows)
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    n_rows, n_groups = rows.count(), groups.count()
    placed = balance(groups, shards, n_groups)
    out = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "shard")
    return dense_positions(out, "shard", ["doc_id", "text_crc32"], n_rows, out="slot")


def op3_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 with near equal bytes."""
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
