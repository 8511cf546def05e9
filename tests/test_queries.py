"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf_dir, con, name):
    got, want = ordered(QUERIES[name](spark, sf_dir).toPandas()), ordered(con.execute(SQL[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    for c in got.columns:
        assert (got[c].astype(object) == want[c].astype(object)).all(), c


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
