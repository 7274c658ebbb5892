"""Exact top-k by exhaustive term-at-a-time accumulation.

Components are terms. A block of candidates becomes one posting list a term; each query scatters
its weighted postings into a dense array of scores, a partial selection keeps the block's best k,
and the blocks' lists are merged by query. Blocks of queries meet blocks of candidates on a grid.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bucket_of, table

K = 20
CANDIDATES = 8192
QUERIES = 2048


def _matrix(rows: pd.Series) -> np.ndarray:
    width = max((len(x) for x in rows), default=0)
    out = np.zeros((len(rows), width), np.int64)
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def best_in_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, block: np.ndarray, k: int) -> tuple[list, list, list]:
    """The k best candidates of one block for each query, ties to the smaller id, never the query's own id."""
    order = np.argsort(ids, kind="stable")
    ids, block = ids[order], block[order]
    postings = []
    for d in range(min(queries.shape[1], block.shape[1])):
        at = np.flatnonzero(block[:, d])
        postings.append((slice(None) if len(at) == len(ids) else at, block[at, d]))
    q_out, id_out, score_out = [], [], []
    for qid, q in zip(query_ids, queries, strict=True):
        scores = np.zeros(len(ids), np.int64)
        for d in np.flatnonzero(q[: len(postings)]):
            at, weights = postings[d]
            scores[at] += q[d] * weights
        own = np.searchsorted(ids, [qid, qid + 1])
        keep = np.r_[0 : own[0], own[1] : len(ids)]
        if len(keep) > k:
            kept = scores[keep]
            keep = keep[kept >= np.partition(kept, len(kept) - k)[len(kept) - k]]
        keep = keep[np.lexsort((ids[keep], -scores[keep]))][:k]
        q_out += [qid] * len(keep)
        id_out += ids[keep].tolist()
        score_out += scores[keep].tolist()
    return q_out, id_out, score_out


def _cell(k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, v, s = best_in_block(left["query_id"].to_numpy(), _matrix(left["q"]), right["vec_id"].to_numpy(), _matrix(right["v"]), k)
        return pd.DataFrame({"query_id": q, "vec_id": v, "score": s}, dtype="int64")

    return search


def top_k(vectors: DataFrame, every: int, k: int = K, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all others.

    Components become floor(scale * x). Null ids or vectors, and vectors with a null or non-finite
    component, take no part; shorter vectors count as padded with zeros. Rows that repeat an id are
    candidates each (never of their own id) and one query together. Ties go to the smaller id.
    Scores are 64-bit sums: components beyond about 2**28 after scaling may wrap round.
    """
    ok = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(ok).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n, m = rows.count(), asked.count()
    a, b = max(1, -(-n // candidates)), max(1, -(-m // queries))
    grid = lambda width: F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    left = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), bucket_of(F.xxhash64("vec_id"), b).cast("int").alias("j"), grid(a).alias("i"))
    right = rows.select("vec_id", "v", bucket_of(F.xxhash64("vec_id"), a).cast("int").alias("i"), grid(b).alias("j"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(_cell(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_taat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every vector whose id is divisible by 20."""
    return top_k(table(spark, sf_dir, "embeddings"), every=20)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
