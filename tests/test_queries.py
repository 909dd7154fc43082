"""Every registered query against its SQL, or at least run, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from doctrail.plans.queries import QUERIES, SQL, flagship

DATA = Path(os.environ.get("DOCTRAIL_DATA", "/root/testdata/sf0.001"))
TABLES = "documents events conversations pages part".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(repr, frame.where(frame.notna(), None).values.tolist()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_flagship(spark):
    assert flagship(spark, str(DATA)).count() > 0
