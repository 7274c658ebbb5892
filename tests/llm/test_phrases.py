"""Collocations against plain counting and DuckDB."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from seamline.llm import phrases

from . import data


def plain(rows, least, longest, replaced, top):
    """lang, rank, phrase, a, l, r, n, score by counting every phrase."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            w = tuple(x for x in re.split(r"[ \t]", piece) if x)
            n[lang] += len(w)
            f.update((lang, w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    found = {}
    for (lang, w), a in candidates.items():
        if 100 * longer[lang, w] < replaced * a:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in found.items() for i, x in enumerate(sorted(xs)[:top]))


def result(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize(("chunk", "cut"), [(2_000_000, 1 << 20), (7, 1)])
def test_awkward_rows(spark, monkeypatch, chunk, cut):
    monkeypatch.setattr(phrases, "SLICE_BYTES", cut)
    got = result(phrases.collocations(data.frame(spark).repartition(3), least=3, chunk_words=chunk))
    assert got == plain([r[1:3] for r in data.rows()], 3, 4, 80, 2000) and len(got) > 100


def sentences(n, seed=4):
    """Texts of few words, with fixed phrases and breaks; a third are one text, and one text is long."""
    rng = random.Random(seed)
    words, fixed = ["a", "B", "c-d", "éé", "x", "the"], ["new york city hall", "in the end", "A b", "at\tlarge"]
    make = lambda m: " ".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) + rng.choice(["", "", ".", ",", "\n", "! "]) for _ in range(m))
    return [("the same. text in the end" if i % 3 == 0 else make(rng.randint(0, 60)), rng.choice(["en", "de", None, "und"])) for i in range(n)] + [(make(6000), "en")]


@pytest.mark.parametrize(("least", "longest", "replaced", "top"), [(5, 5, 60, 20), (2, 2, 80, 3)])
def test_parameters(spark, least, longest, replaced, top):
    rows = sentences(300)
    given = [(i, *r, "s") for i, r in enumerate(rows)]
    got = result(phrases.collocations(data.frame(spark, given).repartition(4), least, longest, replaced, top, chunk_words=500))
    assert got == plain(rows, least, longest, replaced, top) and got


def test_chunks_end_anywhere(spark):
    """One text in a chunk for each word: phrases across each border are counted once."""
    rows = [(" ".join(random.Random(1).choices(["a", "b", "c.", "d"], k=300)), "en")]
    want = plain(rows, 2, 4, 80, 2000)
    assert result(phrases.collocations(data.frame(spark, [(0, *rows[0], "s")]), least=2, chunk_words=1)) == want


@pytest.mark.parametrize(("spread", "names", "n"), [(1, 1, 1), (1, 40, 500), (7, 5_000, 100_000), (1_000, 3_000, 20_000), (1 << 24, 50, 300)])
def test_pairs_as_steps(spread, names, n):
    rng = np.random.default_rng(3)
    name = 1 << phrases.WORDS_BITS | rng.integers(0, spread, names) << phrases.BUCKET_BITS | rng.integers(0, 1 << 35 if names == 50 else 10_000, names)
    pair = np.unique(rng.integers(0, names, (2, n)), axis=1)  # as a chunk comes on them, not by name
    l, r = phrases._dense(name[pair[0]], spread), phrases._dense(name[pair[1]], spread)
    order = np.lexsort((r, l))
    l, r = l[order], r[order]
    packed = phrases.pack_pairs(l, r)
    found = phrases.unpack_pairs(packed["l"], packed["r"], 1, spread)
    assert [x.tolist() for x in found] == [name[pair[k]][order].tolist() for k in (0, 1)]
    if n == 100_000:  # one bucket of eight: what it had in the order of the chunk's words, with places, and what it has now
        at = np.flatnonzero(rng.integers(0, 8, pair.shape[1]) == 0)
        plain = [phrases.pack(y) for y in (name[pair[0, at]], name[pair[1, at]], np.diff(at, prepend=0))]
        own = np.sort(np.argsort(order)[at])
        now = phrases.pack_pairs(l[own], r[own])
        assert sum(map(len, now.values())) + len(phrases.pack(np.diff(np.arange(len(own)), prepend=0))) < 0.7 * sum(map(len, plain))


def test_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_000_000_000_000, [9_100_000_000_000], [9_200_000_000_001])], "f long, firsts array<long>, lasts array<long>")
    assert df.selectExpr(f"{phrases._SCORED}.score AS s").first().s == 2_000_000 * 9_000_000_000_000 // (9_100_000_000_000 + 9_200_000_000_001)


def test_nothing_to_find(spark):
    assert phrases.collocations(data.frame(spark, [])).count() == 0
    assert phrases.collocations(data.frame(spark, [(1, None, None, "s"), (2, "", "en", "s"), (3, "one. two", "en", "s")]), least=1).count() == 0


def test_query(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = result(phrases.op11_pair_naming_phrases(spark, sf_dir))
    assert got == sorted(con.sql(phrases.OP11_SQL).fetchall())
    assert got == plain([tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang").collect()], 30, 4, 80, 2000)
