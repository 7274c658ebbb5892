"""The pipeline's stages on a small table, each against what it must keep."""

from __future__ import annotations

import corpus_pipeline
from seamline.llm import mixing, quality

from . import brute, data

OWN = ["kept", "base", "found", "masked", "mix_slot", "mix_position", "n_words", "k0", "row", "hash", "key", "c1"]


def test_stages_keep_columns_named_like_their_own(spark, sf_dir):
    """Nulls, empty and repeated rows, and clashing names: each stage returns such columns unchanged."""
    from pyspark.sql import functions as F

    rows = data.frame(spark).select("doc_id", "text", "lang", "source").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 1000, "text", "lang", "source"))
    docs = rows.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in OWN})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "encoding":
            assert out.count() == docs.count() and sorted(r.mix_position for r in out.collect()) == list(range(docs.count()))
            continue
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c} {-1 if r.doc_id is None else r.doc_id}" for r in got for c in OWN)
        assert all(r.text is None or r.n_chars == len(r.text) for r in got)
        if name in ("secret_scan", "source_mix"):
            assert len(got) == docs.count()


def test_positions_come_from_the_files_of_the_mix(spark, sf_dir, tmp_path, monkeypatch):
    """The place in the written files is the mix's own; rows that are no whole files are mixed again."""
    monkeypatch.setattr(corpus_pipeline, "FILE_ROWS", 30)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    corpus_pipeline.source_mix(spark, docs, sf_dir).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    assert corpus_pipeline._in_files(mixed) and not corpus_pipeline._in_files(mixed.where("doc_id % 2 = 0")) and not corpus_pipeline._in_files(mixed.groupBy("doc_id").count())
    placed = {r.doc_id: r.mix_position for r in corpus_pipeline._placed(mixed).collect()}
    assert placed == {r.doc_id: r.mix_position for r in mixing.mix(docs, mixing.TARGET_WEIGHTS, mixing.REST_WEIGHT).collect()}
    half = corpus_pipeline.encoding(spark, mixed.where("doc_id % 2 = 0"), sf_dir).collect()
    assert sorted(r.mix_position for r in half) == list(range(len(half)))


def test_stages_of_an_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    assert [stage(spark, docs, sf_dir).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, out = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs
        if name != "encoding":
            assert docs.columns == columns
        if name == "quality_rules":
            kept = {r.doc_id for r in quality.measure(before, ["doc_id"]).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            want = {c for c in (x[1] for x in brute.jaccard_components(rows, 5, 80, 100))}
            assert sorted(r.doc_id for r in docs.collect()) == sorted(want)
        if name == "secret_scan":
            assert all(brute.base_spans(r.text)[2] == 0 for r in docs.collect())
    ran = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r.doc_id, r.ids_sha256) for r in ran} == {(r.doc_id, r.ids_sha256) for r in out["encoding"].collect()}
