"""Lexical search against a plain scorer and DuckDB."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from seamline.llm import lexical

from . import data


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


def ranked(docs, items, k):
    docs = [(d, terms(t)) for d, t in docs]
    docs = [(d, t, Counter(t)) for d, t in docs if t]
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    n, words = len(docs), sum(len(t) for _, t, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for i, ts in asked.items():
        found = []
        for d, t, c in docs:
            m = 50 + 50 * len(t) * n // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 20 * m)) for x in ts if x in c)
            if score > 0:
                found.append((-score, d is not None, d or 0, d))
        out += [(i, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


def items(spark, rows):
    return spark.createDataFrame([(*r, 1.0) for r in rows], "item_id long, text string, doc_id double")


ITEMS = [(1, "w1 W2 w3, the of and日本"), (2, "Ünï the"), (2, "THE w9"), (3, None), (3, ""), (4, "nowhere-at all"), (None, "w5 w6"), (5, "a b c line one"), (6, " ".join(f"w{i}" for i in range(300)))]


@pytest.mark.parametrize(("k", "cells", "block_terms", "cut"), [(50, 1 << 20, 200_000, 1 << 20), (3, 8, 200_000, 20), (2, 40, 120, 5)])
def test_search(spark, monkeypatch, k, cells, block_terms, cut):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "SLICE_BYTES", cut)
    got = [tuple(r) for r in lexical.search(data.frame(spark).repartition(3), items(spark, ITEMS), k, block_terms=block_terms).collect()]
    assert sorted(got, key=repr) == sorted(ranked([r[:2] for r in data.rows()], ITEMS, k), key=repr)


def test_many_documents_of_few_terms(spark):
    """Ties everywhere, and thresholds that prune: a third of the rows are one text."""
    rng = random.Random(2)
    words = [f"t{i}" for i in range(60)]
    rows = [(i, "t1 t2 t3 t3 same" if i % 3 == 0 else " ".join(rng.choices(words, weights=range(1, 61), k=rng.randint(1, 40))), "en", "s") for i in range(1500)]
    asked = [(i, " ".join(rng.choices(words, k=6))) for i in range(40)]
    got = [tuple(r) for r in lexical.search(data.frame(spark, rows).repartition(5), items(spark, asked), 7).collect()]
    assert sorted(got) == sorted(ranked([r[:2] for r in rows], asked, 7))


def test_others_can_not_reach_the_threshold():
    block = lexical._block([(1, [b"a", b"b", b"c"])], {b"a": 0, b"b": 1, b"c": 2}, [type("R", (), {"term": t, "df": d, "top": 900_000, "kth": h}) for t, d, h in ((0, 2, 800_000), (1, 60, 700_000), (2, 95, 700_000))], 100, 1000)
    leads, rest = block.split(block.seed)
    assert block.term.tolist() == [0, 1, 2] and leads.tolist() == [True, False, False]
    assert rest[0] == block.bound[1:].sum() < block.seed[0]


def test_long_text(spark):
    text = " ".join(f"w{i % 977}" for i in range(400_000))
    rows = [(1, text, "en", "s"), (2, "w1 w2", "en", "s"), (3, "x", "en", "s")]
    got = [tuple(r) for r in lexical.search(data.frame(spark, rows), items(spark, [(1, "w1 w3 x")])).collect()]
    assert sorted(got) == sorted(ranked([r[:2] for r in rows], [(1, "w1 w3 x")], 50))


def test_empty_tables(spark):
    assert lexical.search(data.frame(spark, []), items(spark, ITEMS)).count() == 0
    assert lexical.search(data.frame(spark), items(spark, [])).count() == 0
    assert lexical.search(data.frame(spark, [(1, None, "en", "s"), (2, " .", "en", "s")]), items(spark, ITEMS)).count() == 0


def test_query(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = sorted(map(tuple, lexical.op13_threshold_seeded_search(spark, sf_dir).collect()))
    assert got == sorted(con.sql(lexical.OP13_SQL).fetchall())
    docs, asked = ([tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.col(c).alias("id"), "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == sorted(ranked(docs, asked, 50))
