"""Every query with SQL against DuckDB, and every one's columns over the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

from seamline.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def values(rows, columns):
    plain = lambda x: float(x) if isinstance(x, float) else str(x) if hasattr(x, "year") else x
    return Counter(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_duckdb(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    res = con.execute(queries.SQL[name])
    columns = [c[0] for c in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert values([tuple(r) for r in df.collect()], df.columns) == values(res.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
