"""Chat formatting with cumulative-snapshot collapse.

Each turn is hashed with its place, and the running sums of a conversation's turn hashes are its prefix
hashes: the sum after k turns stands for the first k turns. A logged conversation is a snapshot if its last hash is the
hash of as many turns of a longer one; an anti-join drops those, one of equal conversations stays,
and only the maximal ones are rendered. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, table

#: How a turn is written, and a conversation's end.
TURN, END = "<|{role}|>\n{text}\n", "<|end|>"
#: A turn's hash is summed as this many numbers of 32 bits.
LIMBS = 4


def _limbs(place: Column, role: Column, text: Column) -> list[Column]:
    """Hash of a turn at its place, as LIMBS numbers."""
    digest = F.sha2(F.concat_ws("|", place.cast("string"), _part(role), _part(text)), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(LIMBS)]


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, hash (of the turns so far), last: a row for each turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    names = [f"h{i}" for i in range(LIMBS)]
    placed = turns.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    hashed = placed.select("*", *[h.alias(n) for n, h in zip(names, _limbs(F.col("place"), F.col("role"), F.col("text")), strict=True)])
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = F.array(*[F.pmod(F.sum(n).over(so_far), F.lit(1 << 32)) for n in names])
    return hashed.select("conv_id", "place", "role", "text", sums.alias("hash"), F.lead("place").over(order).isNull().alias("last"))


def _part(value: Column) -> Column:
    """A field with its length, so that no two pairs of fields read alike; null is not empty."""
    return F.coalesce(F.concat(F.length(value).cast("string"), F.lit(":"), value), F.lit("null"))


def rendered(turns: Column) -> Column:
    """Turns written out in order; a null role is "unknown", a null text empty."""
    head, middle = TURN.split("{role}")
    middle, tail = middle.split("{text}")
    one = lambda t: F.concat(F.lit(head), F.coalesce(t["role"], F.lit("unknown")), F.lit(middle), F.coalesce(t["text"], F.lit("")), F.lit(tail))
    return F.concat(F.array_join(F.transform(turns, one), ""), F.lit(END))


def collapse(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to one row for each maximal conversation: conv_id, n_turns, n_copies, rendered.

    Turns are ordered by turn, then role and text; turn numbers themselves don't count, repeated
    rows are turns each. Of conversations with the same turns the smallest conv_id stays, and
    n_copies counts them. Rows with a null conv_id are one conversation; null roles and texts are
    values of their own. Other columns play no part. Empty input gives an empty result. One kept
    conversation is held in one row, as its rendering is; hashes are sums over sorted rows, linear in the turns. Copies and common beginnings of many are
    reduced to distinct hashes before they meet.
    """
    rows = cut(_prefixes(turns))
    distinct = rows.where("last").groupBy("hash", F.col("place").alias("n_turns")).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("least"), F.count(F.lit(1)).alias("n_copies"))
    inner = rows.where("not last").select("hash").distinct()
    maximal = distinct.join(inner, "hash", "left_anti").select(F.struct("least.conv_id").alias("key"), "n_turns", "n_copies")
    kept = rows.withColumn("key", F.struct("conv_id")).join(maximal, "key")  # a struct is never null: joined and grouped by one partitioning
    whole = kept.groupBy("key").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    return whole.select("key.conv_id", "n_turns", "n_copies", rendered(F.col("turns")).alias("rendered"))


def op8_snapshot_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal conversations, rendered."""
    return collapse(table(spark, sf_dir, "conversations"))


OP8_SQL = """
WITH w AS (
  SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS turns
  FROM conversations GROUP BY conv_id),
p AS (
  SELECT conv_id, n_turns, list_transform(turns, lambda t: {'r': t.role, 't': t.text}) AS turns FROM w),
d AS (
  SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p GROUP BY turns, n_turns),
i AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM d))
SELECT conv_id, n_turns, n_copies,
  list_aggregate(list_transform(turns, lambda t: '<|' || coalesce(t.r, 'unknown') || '|>' || chr(10) || coalesce(t.t, '') || chr(10)), 'string_agg', '') || '<|end|>' AS rendered
FROM d WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.turns = d.turns)
"""
