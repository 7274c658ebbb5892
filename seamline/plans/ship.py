"""Send the package to executors, for sessions started without it on their Python path."""

from __future__ import annotations

import functools
import tempfile
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once a context."""
    context = spark.sparkContext
    if context in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="spark-")) / "seamline.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "seamline").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(target))
    _shipped.add(context)


def shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent along first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
