"""From raw documents to token ids: quality, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. ``docs`` has doc_id, text, lang and source; any further columns,
also ones named like a stage's own (kept, base, found, masked, mix_slot, ...), come out unchanged, but for n_chars
where a text changes. Null ids, languages and sources are values of their own; what becomes of null and empty texts,
copies and repeated rows is said at each stage. An empty table goes through as one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seamline.llm import bpe, jaccard, mixing, quality, secrets
from seamline.llm.common import table, written

#: Rows of a file of mixed documents.
FILE_ROWS = 16_384


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns c0, c1, ..., so that none is named like what a stage adds, and these names by the first ones."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def _named(rows: DataFrame, at: dict[str, str], new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of ``docs`` by their first names again, those in ``new`` replaced."""
    return rows.select(*[(new or {}).get(name, F.col(c)).alias(name) for name, c in at.items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that the quality rules keep. Null, empty and short texts go; repeated rows are judged each."""
    rows, at = _numbered(docs)
    return _named(quality.measure(rows, rows.columns, at["text"], at["lang"]).where("kept"), at)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    Texts without words (null, empty) are linked with nothing and stay; of repeated rows one stays.
    """
    rows, at = _numbered(docs)
    return _named(jaccard.keep_one(rows, 5, 80, 100, at["doc_id"], at["text"]), at)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked, and n_chars set anew where a text changed. Null and empty texts have none and stay."""
    rows, at = _numbered(docs)
    found = secrets.scan(rows, at["doc_id"], at["text"])
    hit = F.size("found") > 0
    text = F.col(at["text"])
    out = found.withColumn("masked", F.when(hit, secrets.redact(text, F.col("found"))).otherwise(text))
    new = {"text": F.col("masked")}
    if "n_chars" in at:
        new["n_chars"] = F.when(hit, F.char_length("masked")).otherwise(F.col(at["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return _named(out, at, new)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order: written files, and the rows in them, follow the mix. Null sources are mixed with those without a weight.

    Positions have no gaps, so that rows are dealt to files by position alone, without a sample.
    """
    rows, at = _numbered(docs)
    size = rows.count()
    files = max(1, -(-size // FILE_ROWS))
    return _named(_mixed(rows, at).repartitionById(files, F.expr(f"cast(mix_position div {FILE_ROWS} as int)")).sortWithinPartitions("mix_position"), at)


def _mixed(rows: DataFrame, at: dict[str, str]) -> DataFrame:
    return mixing.mix(rows, mixing.TARGET_WEIGHTS, mixing.REST_WEIGHT, id_col=at["doc_id"], source_col=at["source"])


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with mix_position: each row's place in the files that source_mix wrote, by the files' numbers and the rows' in them.

    One count a file meets in one task and is broadcast.
    """
    place = docs.select("*", F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    number = F.regexp_extract("mix_file", r"part-(\d+)", 1).cast("long")
    before = F.coalesce(F.sum("n").over(Window.orderBy("number", "mix_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = place.groupBy("mix_file").agg(F.count(F.lit(1)).alias("n")).withColumn("number", number).select("mix_file", before.alias("mix_before"))
    return place.join(F.broadcast(counts), "mix_file").withColumn("mix_position", F.col("mix_before") + F.col("mix_row"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, mix_position, n_tokens, ids and digests of ids and of what they decode to, a row a document.

    A table has no order of its own: mix_position is the row's place in the files of the stage before; of rows that are in no files,
    the place that the mix gives. Null and empty texts have no ids; repeated rows are encoded each.
    """
    import public_tokenizers

    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = docs.select("doc_id", "source", "text")
    if _in_files(rows):
        mixed = _placed(rows)
    else:
        numbered, at = _numbered(rows)
        mixed = _named(_mixed(numbered, at), at | {"mix_position": "mix_position"})
    return bpe.encode(mixed.select("doc_id", "source", "mix_position", "text"), str(public_tokenizers.path(bpe.RANKS)), public_tokenizers.PATTERN, ["doc_id", "source", "mix_position"], chars=chars)


def _in_files(docs: DataFrame) -> bool:
    """Whether ``docs`` has all rows of the files that it is read from, so that each row's place there is known."""
    try:
        places = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return False
    whole = places.groupBy("file").agg((F.count(F.lit(1)) == F.max("row") + 1).alias("whole"))
    return bool(whole.agg(F.every("whole")).first()[0])


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("source_mix", source_mix), ("encoding", encoding)]

#: SQL can't express the hashes' and models' stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each but the last written as Parquet."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
