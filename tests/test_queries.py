"""Every registered query of the engine's own operators against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from sparkloom.plans import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(x):
    return float(f"{x:.9g}") if isinstance(x, float) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in SQL:
        found = duck.sql(SQL[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    else:
        assert got
