"""Every registered query against its SQL on the smallest tables, and the entry module's contract."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from quern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist") or isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v if v is None or isinstance(v, bool | str) else float(v) if type(v).__name__ in ("Decimal", "int") else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(name, spark, sf, con):
    want = con.sql(registry.ORACLE[name])
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    rows = Counter(tuple(map(plain, r)) for r in got.select(*[f"`{c}`" for c in want.columns]).collect())
    assert rows == Counter(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).limit(5).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
