import os

import duckdb
import pytest

from sheetwise.plans import catalog, drawings  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in catalog.ORACLE:
        rel = duck.execute(catalog.ORACLE[name])
        columns = [d[0] for d in rel.description]
        assert sorted(columns) == sorted(got.columns)
        plain = lambda v: round(float(v), 6) if isinstance(v, float) else v
        want = sorted(repr(tuple(plain(dict(zip(columns, r))[c]) for c in got.columns)) for r in rel.fetchall())
        assert sorted(repr(tuple(plain(v) for v in r)) for r in rows) == want
