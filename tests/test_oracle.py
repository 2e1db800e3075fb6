"""Every query with SQL of its result, side by side with DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = entry.oracle_sql()
#: Without a row at this scale; all others have some.
EMPTY = ("dedupe_conflicts", "search_short_prefix")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


def rows(found):
    return sorted(tuple(plain(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    got = rows(df.select(*columns).collect())
    assert got == rows(want.select(*(f'"{c}"' for c in columns)).fetchall())
    assert bool(got) == (name not in EMPTY)


def test_entry(spark):
    assert sorted(r["kind"] for r in entry.entry(spark).collect()) == ["added", "recompanied", "relinked", "removed", "retitled"]
