"""Corpus queries against their SQL on the small tables."""

import os

import duckdb
import pytest

from folioflow.llm.registry import ORACLE_SQL, QUERIES

from .test_contracts import DATA

TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        duck.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
