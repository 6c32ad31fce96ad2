"""Every query of the catalog against its SQL, over the smallest tables."""

import os

import duckdb
import pytest

from lodestrata import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rel = duck.sql(catalog.ORACLES[name])
    assert sorted(rel.columns) == names
    key = lambda row: [(v is None, str(v)) for v in row]
    mine = sorted(([plain(r[c]) for c in names] for r in got.collect()), key=key)
    theirs = sorted(([plain(r[rel.columns.index(c)]) for c in names] for r in rel.fetchall()), key=key)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, DATA).count() > 0
