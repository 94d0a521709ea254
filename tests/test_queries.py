"""Queries against their SQL on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

from tripleforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(registry.ORACLES)


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, Decimal):
        v = float(v)
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    got = con.sql(registry.ORACLES[name])
    columns = sorted(df.columns)
    at = [got.columns.index(c) for c in columns]
    assert sorted(got.columns) == columns
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == sorted(repr(tuple(plain(r[i]) for i in at)) for r in got.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
