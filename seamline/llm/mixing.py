"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_rows`` rows. Block k of a source with weight a/A may
start at slot floor(k*A/a) and is due by ceil((k+1)*A/a); in each slot the earliest deadline goes
first. Such a schedule repeats after A slots, so that one period, which weights alone fix, places
any number of blocks: the driver sees the weights and one count a source, never rows. When a source
is used up, the next phase begins with the weights of those left, so that no row is dropped; within
a phase each source's share deviates by less than one block from its target.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_positions, table

#: Target weights of the query and the pipeline, in hundredths; other sources share REST_WEIGHT.
TARGET_WEIGHTS = {"src0": 20, **{f"src{i}": 4 for i in range(1, 20)}}
REST_WEIGHT = 4
BLOCK_ROWS = 64
REST = "(rest)"
ADDED = ("mix_block", "mix_slot", "mix_position")


def edf_period(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period, by earliest deadline among released blocks."""
    total = sum(weights.values())
    waiting = [(0, -(-total // a), s, 0) for s, a in sorted(weights.items())]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        due, s, k = heapq.heappop(ready)
        slots.append(s)
        a = weights[s]
        heapq.heappush(waiting, ((k + 1) * total // a, -(-(k + 2) * total // a), s, k + 1))
    return slots


@dataclass
class Phase:
    """Slots from ``start`` on; ``first`` and ``end`` bound the blocks of each source that it places."""

    start: int
    weights: dict[str, int]
    at: dict[str, list[int]]
    first: dict[str, int]
    end: dict[str, int]


def phases(blocks: dict[str, int], weights: dict[str, int]) -> list[Phase]:
    """Phases until every block has its slot."""
    done = dict.fromkeys(weights, 0)
    start, out = 0, []
    active = {s: a for s, a in weights.items() if blocks.get(s, 0) > 0}
    while active:
        period, at = edf_period(active), {s: [] for s in active}
        for slot, s in enumerate(period):
            at[s].append(slot)
        total = len(period)
        last = {}
        for s, a in active.items():
            k = blocks[s] - done[s] - 1
            last[s] = k // a * total + at[s][k % a]
        length = min(last.values()) + 1
        now = {s: done[s] + length // total * a + sum(x < length % total for x in at[s]) for s, a in active.items()}
        out.append(Phase(start, active, at, {s: done[s] for s in active}, now))
        start += length
        done |= now
        active = {s: a for s, a in active.items() if done[s] < blocks[s]}
    return out


def slot_of(plan: list[Phase], source: str, block: int) -> int:
    """The slot of one block, as the joins in mix() find it."""
    p = next(p for p in plan if source in p.first and p.first[source] <= block < p.end[source])
    k, a = block - p.first[source], p.weights[source]
    return p.start + k // a * sum(p.weights.values()) + p.at[source][k % a]


def mix(docs: DataFrame, weights: dict[str, int], rest_weight: int = 1, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Add mix_block, mix_slot and mix_position (0 to rows - 1 without gaps) to ``docs``.

    Null sources and those without a weight share one pooled source of weight ``rest_weight``.
    Rows of a source are ordered by a hash of id and source; repeated rows each get a position;
    null ids are ordered like any value. An empty input gives an empty result. Other columns stay,
    whatever their names, and a column named like an added one is replaced. Weights are positive;
    their number and sum bound the broadcast tables.
    """
    spark = docs.sparkSession
    names = [s for s in weights if weights[s] > 0]
    columns = [c for c in docs.columns if c.lower() not in ADDED]
    source = F.col(f"`{source_col}`")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), source.alias("source"), F.when(source.isin(names), source).otherwise(F.lit(REST)).alias("src"))
    rows = {r[0]: r[1] for r in df.groupBy("src").count().collect()}  # one a weight at most
    number = dense_positions(df, "src", ["id", "source"], sum(rows.values()), out="_pos")
    plan = phases({s: -(-n // block_rows) for s, n in rows.items()}, {s: weights[s] for s in names} | {REST: max(1, rest_weight)})
    spans, places = [], []
    for i, p in enumerate(plan):
        total = sum(p.weights.values())
        for s, a in p.weights.items():
            spans.append((s, i, p.first[s], p.end[s], p.start, a, total))
            places += [(s, i, k, x) for k, x in enumerate(p.at[s])]
    short = [(slot_of(plan, s, -(-n // block_rows) - 1), -n % block_rows) for s, n in rows.items() if n % block_rows]
    span = spark.createDataFrame(spans, "p_src string, p_phase int, p_first long, p_end long, p_start long, p_a long, p_total long")
    place = spark.createDataFrame(places, "q_src string, q_phase int, q_k long, q_slot long")
    out = number.withColumn("mix_block", F.expr(f"_pos div {block_rows}"))
    out = out.join(F.broadcast(span), (F.col("src") == F.col("p_src")) & (F.col("mix_block") >= F.col("p_first")) & (F.col("mix_block") < F.col("p_end")))
    out = out.withColumn("_k", F.col("mix_block") - F.col("p_first"))
    out = out.join(F.broadcast(place), (F.col("src") == F.col("q_src")) & (F.col("p_phase") == F.col("q_phase")) & (F.col("_k") % F.col("p_a") == F.col("q_k")))
    out = out.withColumn("mix_slot", F.col("p_start") + F.expr("(_k div p_a) * p_total") + F.col("q_slot"))
    missing = sum((F.when(F.col("mix_slot") > at, F.lit(n)).otherwise(F.lit(0)) for at, n in short), F.lit(0))
    out = out.withColumn("mix_position", F.col("mix_slot") * block_rows - missing + F.col("_pos") % block_rows)
    return out.select(*[F.col("row").getField(c).alias(c) for c in columns], *ADDED)


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in mixed order: doc_id, source, block, slot, position."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    out = mix(docs, TARGET_WEIGHTS, REST_WEIGHT)
    return out.select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_position").alias("position"))
