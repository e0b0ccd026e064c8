"""Every named query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from scoresheet_spark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
    return sorted(repr(tuple(cell(r[i]) for i in order)) for r in values)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sql, name):
    df = registry.queries()[name](spark, SF)
    found = sql.execute(registry.oracle_sql()[name])
    expected = [d[0] for d in found.description], found.fetchall()
    assert sorted(df.columns) == sorted(expected[0])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(*expected)
