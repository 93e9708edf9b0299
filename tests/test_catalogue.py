"""Every registered query of the engine against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from voxframe.plans import catalogue, catalogue_training  # noqa: F401  (registers its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def told(v):
    return repr(0.0 if v == 0 else v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLES:
        assert df.columns
        return
    r = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in r.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    want = sorted(tuple(told(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(told(row[c]) for c in cols) for row in rows) == want
