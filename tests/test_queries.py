"""Every registered query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from glossweave.oracles import ORACLES
from glossweave.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(rows):
    shown = lambda x: round(x, 6) + 0.0 if isinstance(x, float) and math.isfinite(x) else x
    return sorted((tuple(shown(x) for x in r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        path = f"{SF}/{name}" + ("/*.parquet" if os.path.isdir(f"{SF}/{name}") else "")
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = plain(df.select(*[df[c] for c in names]).collect())
    if name not in ORACLES:
        assert got
        return
    found = sql.execute(ORACLES[name])
    order = [c[0] for c in found.description]
    assert sorted(order) == names
    assert got == plain(tuple(r[order.index(c)] for c in names) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
