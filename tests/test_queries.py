"""Every query with SQL gives DuckDB's rows: the same columns, kinds of values, and values to six digits."""

import os

import duckdb
import pytest

from auditlake import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def value(x):
    if x is None or x != x:
        return None
    return round(x, 6) + 0.0 if isinstance(x, float) else x


def kind(x):
    return "number" if isinstance(x, (int, float)) and not isinstance(x, bool) else type(x).__name__


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(DIR)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DIR}/{f}'")
    found = con.execute(registry.ORACLES[name])
    cols = [c[0] for c in found.description]
    want = [dict(zip(cols, r, strict=True)) for r in found.fetchall()]
    got = registry.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(cols)
    got = [r.asDict() for r in got.collect()]
    a, b = (sorted(([(kind(r[c]), value(float(r[c]) if kind(r[c]) == "number" else r[c])) for c in sorted(cols)] for r in rows), key=str) for rows in (got, want))
    assert a == b and (len(b) > 0)
