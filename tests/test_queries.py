"""Every registered query with SQL gives the same rows as the SQL on the smallest tables."""

import datetime
import glob
import math
import os

import pytest

import __spark_entry__ as entry
from lakeloom.plans import registry

DIR = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


def _cell(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are missing")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = registry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted([tuple(_cell(r[c]) for c in cols) for r in df.collect()], key=repr)
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(SQL[name])
    names = [c[0] for c in cur.description]
    at = [names.index(c) for c in cols]
    want = sorted([tuple(_cell(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in cur.fetchall()], key=repr)
    assert sorted(names) == cols and len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(float(x) - float(y)) < 1e-5) or str(x) == str(y) for x, y in zip(a, b))


def test_entry_is_stable(spark):
    assert set(registry.queries()) <= set(entry.queries())
    if os.path.isdir(DIR):
        assert entry.entry(spark).columns == ["query", "key", "rrf", "rnk"]
