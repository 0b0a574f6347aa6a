"""Every registered query runs at the smallest scale, with the columns of its SQL and its rows."""

import os

import duckdb
import pytest

from shelfmark.plans import arriving, cases, catalogue, discoveries, feeds, identities, market, markups, research, resolution, spec_sheets, wordings  # noqa: F401

SF = os.environ.get("SHELFMARK_TEST_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in catalogue.TABLES.split("|"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalogue.ORACLES:
        assert got
        return
    cursor = con.execute(catalogue.ORACLES[name])
    want, columns = cursor.fetchall(), [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns) and len(got) == len(want)
    show = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    at = [df.columns.index(c) for c in columns]
    assert sorted(tuple(show(r[i]) for i in at) for r in got) == sorted(tuple(map(show, r)) for r in want)
