"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from vigil import catalog

SF = "/root/testdata/sf0.001"
#: Series of the smallest tables are shorter than a detector's window.
LONGER = "/root/testdata/sf0.01"


def folder(name):
    return LONGER if name.startswith("detect_") else SF


@pytest.fixture(scope="module")
def duck():
    out = {}
    for root in (SF, LONGER):
        out[root] = duckdb.connect()
        for name in os.listdir(root):
            out[root].sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{root}/{name}'")
    return out


def rows(frame):
    cols = sorted(frame.columns)
    frame = frame[cols].astype({c: float for c in cols if frame[c].dtype.kind in "iuf"}).round(8)
    return cols, sorted(map(str, frame.astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, duck, name):
    got = rows(catalog.QUERIES[name](spark, folder(name)).toPandas())
    assert got == rows(duck[folder(name)].sql(catalog.SQL[name]).df())
    if name.startswith("detect_"):
        assert len(got[1]) > 20


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, folder(name)).count() > 0
