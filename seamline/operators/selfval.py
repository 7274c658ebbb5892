"""Self-validation: robust thresholds, rejection, rounds of fitting and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.functions.stats import MAD_SCALE
from seamline.plans.lineage import cut

from . import coreset, knn
from .ranks import percentiles, ranked


def mad_threshold(scores: DataFrame, keys: list[str], k: float = 3.5) -> DataFrame:
    """keys, median, mad, threshold = median + k * 1.4826 * mad."""
    median = percentiles(scores, keys, "score", {"median": 0.5})
    spread = scores.join(median, keys).withColumn("away", F.abs(F.col("score") - F.col("median")))
    return median.join(percentiles(spread, keys, "away", {"mad": 0.5}), keys).withColumn("threshold", F.col("median") + k * MAD_SCALE * F.col("mad"))


def capped_threshold(scores: DataFrame, keys: list[str], k: float = 3.5, percent: float = 5.0) -> DataFrame:
    """mad_threshold, raised to the percentile that rejects ``percent`` at most."""
    cap = percentiles(scores, keys, "score", {"cap": 1 - percent / 100})
    return mad_threshold(scores, keys, k).join(cap, keys).withColumn("threshold", F.greatest("threshold", "cap"))


def rejected(scores: DataFrame, thresholds: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Rows of ``scores`` at or over (strict: over) their threshold."""
    test = F.col("score") > F.col("threshold") if strict else F.col("score") >= F.col("threshold")
    return scores.join(thresholds.select(*keys, "threshold"), keys).where(test)


def keep_lowest(scores: DataFrame, thresholds: DataFrame, keys: list[str], id_col: str, percent: float = 5.0) -> DataFrame:
    """Rows not over their threshold; where more than ``percent`` are over, all but the highest ``percent`` (by score, then id)."""
    placed = ranked(scores, keys, "score", [id_col]).join(thresholds.select(*keys, "threshold"), keys)
    over = placed.groupBy(*keys).agg(F.count_if(F.col("score") > F.col("threshold")).alias("over"))
    most = F.floor(F.col("n") * percent / 100)
    kept = F.when(F.col("over") > most, F.col("rank") < F.col("n") - most).otherwise(F.col("score") <= F.col("threshold"))
    return placed.join(over, keys).where(kept).select(*scores.columns)


def rescored_threshold(kept: DataFrame, bank: DataFrame, k: float = 3.5) -> DataFrame:
    """median, mad, threshold of the kept rows' scores against their final bank. Both: id, v."""
    scored = cut(knn.scores(kept, bank).withColumn("all", F.lit(0)))
    return mad_threshold(scored, ["all"], k).drop("all")


def validate_once(vectors: DataFrame, ratio: float, k: float = 3.5, percent: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round, then the bank fitted again on the rows kept, and the threshold of their new scores: (kept, bank, threshold)."""
    kept = cut(self_validate(vectors, ratio, 1, k, percent))
    bank = cut(coreset.partitioned(kept.withColumn("model", F.lit(0)), ratio).select("id", "v"))
    return kept, bank, rescored_threshold(kept, bank, k)


def self_validate(vectors: DataFrame, ratio: float, rounds: int = 3, k: float = 3.5, percent: float = 5.0) -> DataFrame:
    """Rows of ``vectors`` (id, v) left after rounds of bank, scores and rejection; rejected keys stay out of later rounds."""
    kept = vectors.select("id", "v")
    for _ in range(rounds):
        bank = coreset.partitioned(kept.withColumn("model", F.lit(0)), ratio)
        scored = cut(knn.scores(kept, bank.select("id", "v")).withColumn("all", F.lit(0)))
        out = rejected(scored, capped_threshold(scored, ["all"], k, percent), ["all"], strict=True).select("id")
        if out.isEmpty():
            break
        kept = cut(kept.join(out, "id", "left_anti"))
    return kept
