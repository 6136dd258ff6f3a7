"""Each query of the catalogue against its DuckDB oracle on the small tables."""

import os

import duckdb
import pytest

from newsloom.plans import catalogue

SF = "/root/testdata/sf0.001"
ORACLE = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 6) if isinstance(v, float) or hasattr(v, "as_tuple") else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
