"""Every query of the core against its SQL on the smallest tables; those without SQL return rows."""

import duckdb
import pytest

from gridloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, sf, name):
    got = plans.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in plans.ORACLES:
        want = db.execute(plans.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        cols = sorted(got.columns)
        key = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
        got, want = key(got), key(want)
        assert len(got) == len(want)
        for c in cols:
            same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
            if got[c].dtype.kind == "f":
                same |= (got[c] - want[c]).abs() < 2e-5 * (1 + want[c].abs())
            assert same.all(), c


def test_every_oracle_has_a_query():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
