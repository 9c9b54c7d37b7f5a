"""Every registered query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb
import pytest

from millrace.plans.catalog import ORACLES, QUERIES

#: Queries without SQL: sequential state or codecs.
NO_SQL = {"near_dedup_sequential", "arith_roundtrip", "classical_codecs", "hybrid_codecs", "language_codecs", "language_benchmark", "tokenizer_sweep", "tokenizer_improvement", "sandhi_ablation", "novel_merges"}


@pytest.fixture(scope="module")
def sql(tables):
    c = duckdb.connect()
    for f in glob.glob(f"{tables}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows):
    one = lambda v: round(float(v), 6) if isinstance(v, (float, decimal.Decimal)) else v
    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


def test_all_have_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sql, tables, name):
    cur = sql.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    df = QUERIES[name](spark, tables)
    assert sorted(df.columns) == sorted(names)
    assert plain(df.select(*names).collect()) == plain(want)
