"""Batches sent to Python are bounded by bytes."""

from __future__ import annotations

import pyarrow as pa

from seamline.llm.common import _BATCH_SETTING, BATCH_BYTES, bound_batches


def _sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})


def test_long_texts_come_in_small_batches(spark):
    spark.conf.unset(_BATCH_SETTING)
    texts = spark.range(0, 400, 1, 1).selectExpr("repeat('x', 100000) AS text").union(spark.range(1).selectExpr("repeat('y', 9000000)"))
    bound_batches(texts)
    found = texts.mapInArrow(_sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in found) == 401
    assert max(r["bytes"] for r in found if r["rows"] > 1) <= BATCH_BYTES + 200_000
    assert any(r["rows"] == 1 and r["bytes"] >= 9_000_000 for r in found)


def test_a_value_of_the_session_stays(spark):
    spark.conf.set(_BATCH_SETTING, "9m")
    bound_batches(spark.range(1))
    assert spark.conf.get(_BATCH_SETTING) == "9m"
    spark.conf.unset(_BATCH_SETTING)
