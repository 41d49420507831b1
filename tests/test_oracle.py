"""Every query with SQL gives the rows that the SQL gives on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(tuple, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_rows_agree(spark, sql, name):
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(sql.sql(oracle.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_others_have_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).limit(1).count() == 1
