"""Every core query against its SQL in DuckDB, over whole tables."""

import math
import os

import duckdb
import pytest

from arborweft.plans import catalog
from tests.conftest import DATA


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def compare(spark, name, fn, sql, d=DATA):
    con = duckdb.connect()
    for f in os.listdir(d):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{d}/{f}')")
    df = fn(spark, d)
    cols = sorted(df.columns)
    rel = con.sql(sql)
    assert cols == sorted(rel.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key)
    want = sorted((tuple(map(norm, r)) for r in rel.select(", ".join(f'"{c}"' for c in cols)).fetchall()), key=key)
    assert got == want, name


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.ORACLE:
        compare(spark, name, catalog.QUERIES[name], catalog.ORACLE[name])
    else:
        catalog.QUERIES[name](spark, DATA).collect()


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
