"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pytest

from draftlake.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return out


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(str(r[i]) for i in order) for r in data))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, SF)
    expected = duck.execute(SQL[name])
    columns = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, expected.fetchall())
