"""Keyset pages tile the order of the whole, and bring the total along."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricledger.operators.paging import Order, fetch_page, sort_keys
from metricledger.params import PageRequest, TimeRange
from metricledger.plans import reads
from tests.conftest import BASE


def all_pages(rows, order, size):
    out, after, totals = [], None, set()
    while True:
        page = fetch_page(rows, order, size, after)
        out += page.rows
        totals.add(page.total)
        after = page.cursor
        if after is None:
            return out, totals


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("field", ["text", "number", "moment"])
def test_pages_tile_the_order(spark, field, order):
    """Ties and NULLs in the sort column, for texts, doubles and timestamps."""
    data = [(i, None if i % 5 == 0 else f"t{i % 3}", None if i % 4 == 0 else float(i % 3), None if i % 7 == 0 else BASE + dt.timedelta(microseconds=i % 4)) for i in range(23)]
    rows = spark.createDataFrame(data, "id long, text string, number double, moment timestamp_ntz").repartition(3)
    fields = {f: F.col(f) for f in ("text", "number", "moment")}
    want = [tuple(r) for r in rows.orderBy(*sort_keys(fields, "text", field, order, ["id"])).collect()]
    got, totals = all_pages(rows, Order.of(fields, "text", PageRequest(sort_by=field, order=order), ["id"]), 4)
    assert [tuple(r) for r in got] == want and totals == {23}


def test_empty_table_and_exact_end(spark):
    rows = spark.createDataFrame([(1, 2), (2, 2)], "id long, x long")
    order = Order.of({"x": F.col("x")}, "x", PageRequest(), ["id"])
    page = fetch_page(rows, order, 2)
    assert [r.id for r in page.rows] == [1, 2] and page.cursor is None
    nothing = fetch_page(rows.limit(0), order, 2)
    assert (nothing.rows, nothing.total, nothing.cursor) == ([], 0, None)


def test_expressions_with_total_and_cursor(spark, make_log):
    log = make_log(*[{"fingerprint": f"f{i % 13}", "ts": BASE + dt.timedelta(seconds=i)} for i in range(100)])
    tr = TimeRange(BASE, BASE + dt.timedelta(hours=1))
    page = reads.fetch_expressions(log, tr, PageRequest(size=5))
    assert page.total == 13 and len(page.rows) == 5
    assert page.rows[0].executions == 8 and page.cursor == (8, page.rows[-1].fingerprint)
    behind = reads.fetch_expressions(log, tr, PageRequest(size=100), page.cursor)
    assert behind.total == 13 and len(behind.rows) == 8 and behind.cursor is None
