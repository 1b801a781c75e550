"""Every registered query against its DuckDB twin."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck, kinds_of

QUERIES, TWINS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in TWINS:
        assert len(got) > 0
        return
    want = con.execute(TWINS[name]).df()
    assert difference(got, want) is None
    assert kinds_of(got) == kinds_of(want)


def test_every_twin_has_a_query():
    assert set(TWINS) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["fingerprint", "query", "executions", "avg_duration", "error_rate_pct", "peak_samples"]
    assert df.count() > 0
