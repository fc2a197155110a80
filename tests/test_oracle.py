"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

from folioflow.plans.oracle import ORACLE_SQL
from folioflow.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: What SQL does not express here: HTML entities, nested raw lines, folds over cut positions, the Python provider, patterns that look around.
ROWS_ONLY = {"clean_translation", "raw_line_blocks", "split_translation", "translated_documents", "parse_response"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def test_only_the_named_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == ROWS_ONLY and set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and got
