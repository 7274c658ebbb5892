"""The last status of each training job from its log lines, as a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: What lines of a training log look like.
SPEC, ROUND = r"Spec:\s+(\S+)\s+\|\s+Group\s+(\d+)", r"Self-validation round\s+(\d+/\d+)"
FEATURES, MASK, SCORING = r"Round\s+(\d+)\s+features:\s+(\d+)%", r"Mask\s+(\S+):\s+(\d+)%", r"Scoring:\s+(\d+)%"
STAGES = {"Coreset selection": "Coreset selection", "Scanning NAS": "Scanning NAS...", "ONNX": "ONNX/TRT setup", "Loading backbone": "Loading backbone..."}
COLOURS = r"\x1b\[[0-9;]*[A-Za-z]"


def parsed(line: Column) -> dict[str, Column]:
    """spec, group, round, and stage with its detail of a line; null where it doesn't tell."""
    line = F.trim(F.regexp_replace(line, COLOURS, ""))
    part = lambda pattern, i: F.nullif(F.regexp_extract(line, pattern, i), F.lit(""))
    stage = lambda name, detail: F.struct(name.alias("stage"), detail.cast("string").alias("detail"))
    percent = lambda x: F.concat(x, F.lit("%"))
    found = F.when(part(FEATURES, 1).isNotNull(), stage(F.concat(F.lit("Feature extraction (Round "), part(FEATURES, 1), F.lit(")")), percent(part(FEATURES, 2))))
    found = found.when(part(MASK, 1).isNotNull(), stage(F.lit("Computing tile masks"), F.concat(part(MASK, 1), F.lit(" ("), percent(part(MASK, 2)), F.lit(")"))))
    found = found.when(part(SCORING, 1).isNotNull(), stage(F.lit("Scoring"), percent(part(SCORING, 1))))
    for sign, name in STAGES.items():
        found = found.when(F.contains(line, F.lit(sign)), stage(F.lit(name), F.lit(None)))
    return {"spec": part(SPEC, 1), "group": part(SPEC, 2).cast("int"), "round": part(ROUND, 1), "stage": found}


def last_status(lines: DataFrame) -> DataFrame:
    """job, spec, group, round, stage, detail, seen: of each, what the latest line that tells it says. ``lines``: job, at (number or time), line.

    Each field is the one of greatest ``at``, so that repeated lines change nothing and late ones only what they are the latest for;
    of lines of one ``at``, the greatest text. Works on streams too, whose state is one row a job.
    """
    told = parsed(F.col("line"))
    rows = lines.select("job", "at", "line", *[c.alias(n) for n, c in told.items()])
    order = F.struct("at", "line")
    last = lambda n: F.max(F.when(F.col(n).isNotNull(), F.struct(order.alias("o"), F.col(n).alias("v"))))["v"]
    out = rows.groupBy("job").agg(*[last(n).alias(n) for n in told], F.max("at").alias("seen"))
    return out.select("job", "spec", "group", "round", "stage.stage", "stage.detail", "seen")


def status_stream(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the last status of the jobs of a stream of lines: each batch writes the jobs that it changed to ``path``/batch=n; a repeated batch replaces itself."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return last_status(lines).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``status_stream`` has written so far: of each job, the row of its last batch."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c not in ("job", "batch")]
    return rows.groupBy("job").agg(F.max_by(F.struct(*columns), "batch").alias("s")).select("job", "s.*")
