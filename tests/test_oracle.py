"""Every registered query against its DuckDB oracle on the sf0.01 tables."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracle import rows_of
from tests.conftest import SF_CHECK
from cadence.sources.testdata import TABLES

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF_CHECK)
    srec = [r.asDict(recursive=True) for r in sdf.collect()]
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    drec = [dict(zip(dcols, r)) for r in cur.fetchall()]
    assert sorted(sdf.columns) == sorted(dcols)
    cols = sorted(dcols)
    assert rows_of(srec, cols) == rows_of(drec, cols)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
