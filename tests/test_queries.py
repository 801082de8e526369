"""Every registered query against its DuckDB statement on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry
from sparkloom.plans.registry import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(x, 9) + 0.0 if isinstance(x, float) else x.item() if hasattr(x, "item") else x


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(repr(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in map(plain, r)) for r in frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
