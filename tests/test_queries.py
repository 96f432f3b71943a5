"""Every core query against its SQL on the smallest tables."""

import os
from pathlib import Path

import pytest

from sightline.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


def agree(df, sql):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    want = con.sql(sql)
    names = want.columns
    assert sorted(names) == sorted(df.columns)
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))
    right = order([tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in want.fetchall()])
    left = order([tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()])
    assert left == right


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    if name in registry.SQL:
        agree(df, registry.SQL[name])
    else:
        assert df.count() > 0
