"""Every core query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quillstone.plans import catalog


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    names = sorted(df.columns)
    cursor = duck.execute(catalog.SQL[name])
    have = [d[0] for d in cursor.description]
    assert sorted(have) == names
    at = [have.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() >= 0
