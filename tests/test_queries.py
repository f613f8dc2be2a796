"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
from loomline.plans import registry  # noqa: E402

NAMES = sorted(registry.oracles())
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(registry.oracles()[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == want


def test_entry_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["rule_id", "lang", "n", "fingerprints"]
    df.collect()


def test_every_query_is_callable():
    assert all(callable(q) for q in entry.queries().values())
    assert set(entry.oracle_sql()) <= set(entry.queries())
