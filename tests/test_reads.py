import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricledger import fixtures as fx
from metricledger.operators import filters as flt
from metricledger.operators import paging
from metricledger.params import PageRequest, TimeRange
from metricledger.plans import reads, timeseries
from tests.compare import difference, duck
from tests.conftest import BASE, plan_of

MINUTE = dt.timedelta(minutes=1)
HOUR = TimeRange(BASE - dt.timedelta(hours=1), BASE + dt.timedelta(hours=1))


def one(df):
    return df.first().asDict()


def test_time_range_defaults_and_previous():
    now = dt.datetime(2024, 5, 1)
    assert TimeRange.default(now).length == dt.timedelta(days=30)
    assert TimeRange.fill(None, now, now).start == now - dt.timedelta(days=30)
    assert TimeRange(BASE, BASE + MINUTE).previous() == TimeRange(BASE - MINUTE, BASE)


def test_query_types(make_log):
    log = make_log({"type": "instant"}, {"type": "range"}, {"type": "range"})
    assert one(reads.query_types(log, HOUR)) == {"total": 3, "instant_pct": 33.33, "range_pct": 66.67}


def test_average_and_delta(make_log):
    old = [{"ts": BASE - 15 * MINUTE, "duration_ms": 10}] * 3
    new = [{"ts": BASE - 5 * MINUTE, "duration_ms": 20}] * 3
    log = make_log(*old, *new)
    window = TimeRange(BASE - 10 * MINUTE, BASE)
    assert one(reads.average_duration(log, window)) == {"avg_current": 20.0, "delta_percent": 100.0}
    nothing = TimeRange(BASE + 5 * MINUTE, BASE + 6 * MINUTE)
    assert one(reads.average_duration(log, nothing)) == {"avg_current": 0.0, "delta_percent": 0.0}


def test_shared_edge_counts_in_both_windows(make_log):
    log = make_log({"ts": BASE, "duration_ms": 8}, {"ts": BASE + MINUTE, "duration_ms": 24})
    got = one(reads.average_duration(log, TimeRange(BASE, BASE + 2 * MINUTE)))
    assert got == {"avg_current": 16.0, "delta_percent": 100.0}


def test_query_rate(make_log):
    log = make_log(*[{"status_code": 200}] * 3, *[{"status_code": 500}] * 2)
    got = one(reads.query_rate(log, HOUR, metric="up"))
    assert got == {"success_total": 3, "success_pct": 60.0, "error_total": 2, "error_pct": 40.0}
    assert one(reads.query_rate(log, HOUR, metric="down"))["success_pct"] is None


def test_metric_match(make_log):
    log = make_log(
        {"label_matchers": [{"__name__": "a"}, {"__name__": "b"}]},
        {"label_matchers": None},
        {"label_matchers": []},
        {"label_matchers": [{"job": "x"}, {"__name__": "b"}]},
    )
    ids = lambda m, how: sorted(r.query_id for r in flt.references_metric(log, m, how).collect())
    assert ids("b", "any") == [0, 3]
    assert ids("b", "first") == []
    assert ids("a", "first") == [0]
    narrow = log.drop("metric_names")
    assert sorted(r.query_id for r in flt.references_metric(narrow, "b").collect()) == [0, 3]


def test_expressions_and_executions(make_log):
    log = make_log(
        {"query_param": 'up{a="1"}', "peak_samples": 5, "status_code": 500},
        {"query_param": 'up{a="2"}', "ts": BASE + MINUTE, "duration_ms": 20, "peak_samples": 3},
        {"query_param": "other", "fingerprint": "g", "type": "range", "step": 15.0},
    )
    page = reads.query_expressions(log, HOUR)
    assert page.counts.first().asDict() == {"total": 2, "total_pages": 1}
    assert page.data.first().asDict() == {
        "fingerprint": "f",
        "query": 'up{a="2"}',
        "executions": 2,
        "avg_duration": 15.0,
        "error_rate_pct": 50.0,
        "peak_samples": 5,
    }
    runs = reads.query_executions(log, HOUR, "f")
    assert [r.steps for r in runs.data.collect()] == [0.0, 0.0]
    assert reads.executions(log, HOUR, "f", "range").count() == 0
    assert reads.executions(log, HOUR, "f", "nonsense").count() == 2


def test_text_filter_keeps_wildcards(make_log):
    log = make_log({"query_param": "rate(Foo[5m])"}, {"query_param": "bar"})
    assert reads.expressions(log, HOUR, "RATE(f%o").first().executions == 1
    assert reads.expressions(log, HOUR, "").first().executions == 2


def test_sorting_falls_back(make_log):
    log = make_log({"fingerprint": "a"}, {"fingerprint": "b"}, {"fingerprint": "b"})
    first = lambda **kw: reads.query_expressions(log, HOUR, PageRequest(**kw)).data.first().fingerprint
    assert first() == "b"
    assert first(order="ASC ") == "a"
    assert first(sort_by="1; drop table", order="sideways") == "b"


def test_page_limits():
    assert paging.clamp_page(0, 0) == (1, 10)
    assert paging.clamp_page(-3, 500) == (1, 100)
    assert paging.clamp_page(2, 20_000, paging.MAX_METADATA_SIZE) == (2, 10_000)
    assert [paging.total_pages(n, 10) for n in (0, 1, 10, 11)] == [0, 1, 1, 2]


def test_nulls_sort_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "id int, v int")
    for order in ("asc", "desc"):
        got = paging.safe_order_by(df, {"v": F.col("v")}, "v", "v", order, ["id"]).collect()
        assert got[-1].id == 1


def test_page_of_sorted_table(spark, tmp_path):
    df = spark.range(5000).withColumn("k", (F.col("id") * 7919) % 5000)
    keys = [F.col("k").desc()]
    paging.write_sorted(df, keys, str(tmp_path / "sorted"))
    rows = spark.read.parquet(str(tmp_path / "sorted"))
    deep = paging.sorted_page(rows, 4321, 7).collect()
    assert [r.position for r in deep] == list(range(4321, 4328))
    assert [r.k for r in deep] == list(range(4999 - 4321, 4999 - 4321 - 7, -1))
    assert paging.sorted_page(rows, 6000, 7).count() == 0


def test_page_as_result(spark, make_log, tmp_path):
    log = make_log({"fingerprint": "a"}, {"fingerprint": "b"})
    page = reads.query_expressions(log, HOUR, PageRequest(size=1))
    target = str(tmp_path / "page")
    page.write_json(target)
    row = spark.read.json(target).first()
    assert (row.total, row.total_pages, len(row.data)) == (2, 2, 1)


def test_executions_of_an_empty_page(make_log):
    log = make_log({})
    page = reads.query_executions(log, HOUR, "missing")
    assert page.counts.first().asDict() == {"total": 0, "total_pages": 0}


def test_range_classes(make_log):
    def back(**kw):
        return {"type": "range", "start_ts": BASE - dt.timedelta(**kw), "end_ts": BASE}

    log = make_log(
        back(hours=23), back(days=1), back(days=7), back(days=30), back(days=60), back(days=90), back(days=0), {}
    )
    got = [(r.label, r["count"], r.percent) for r in timeseries.time_range_distribution(log, HOUR).collect()]
    assert got == [(label, 1, 16.67) for label, _ in timeseries.RANGE_CLASSES]
    none = timeseries.time_range_distribution(make_log({}), HOUR)
    assert [(r["count"], r.percent) for r in none.collect()] == [(0, 0.0)] * 6
    assert timeseries.retention_insight(none).first().tier is None


@pytest.mark.parametrize(
    "percents, tier",
    [
        ((50, 20, 10, 10, 5, 5), "short"),
        ((30, 30, 10, 10, 10, 10), "medium"),
        ((20, 10, 10, 10, 20, 30), "long"),
        ((20, 20, 15, 10, 20, 15), "balanced"),
    ],
)
def test_retention_tiers(spark, percents, tier):
    rows = [(label, 1, float(p)) for (label, _), p in zip(timeseries.RANGE_CLASSES, percents)]
    df = spark.createDataFrame(rows, "label string, count long, percent double")
    assert timeseries.retention_insight(df).first().tier == tier


WINDOWS = {
    "1 minute": TimeRange.of("2024-01-10T00:00:00", "2024-01-10T02:00:00"),
    "5 minutes": TimeRange.of("2024-01-10T00:00:30", "2024-01-10T05:00:00"),
    "15 minutes": TimeRange.of("2024-01-10T00:00:00", "2024-01-11T00:00:00"),
    "1 hour": TimeRange.of("2024-01-03T05:17:23", "2024-01-09T11:41:09"),
    "6 hours": TimeRange.of("2024-01-01T00:00:00", "2024-01-31T00:00:00"),
    "1 day": TimeRange.of("2023-12-01T07:30:11", "2024-02-01T00:00:00"),
}


@pytest.mark.parametrize("stride", WINDOWS)
def test_series_on_every_stride(spark, sf, stride):
    from metricledger import oracle

    tr, log, con = WINDOWS[stride], fx.query_log(spark, sf), duck(sf)
    for read, columns in ((timeseries.status_distribution, oracle._STATUS), (timeseries.latency_trends, oracle._LATENCY)):
        want = con.execute(oracle._series_sql(tr, stride, columns)).df()
        assert difference(read(log, tr).toPandas(), want) is None


def test_percentile_interpolates(make_log):
    log = make_log(*[{"duration_ms": d} for d in (10, 20, 30, 40, 1000)])
    window = TimeRange(BASE, BASE + MINUTE)
    row = timeseries.latency_trends(log, window).first()
    assert (row.value, row.p95) == (220.0, 808)
    assert timeseries.rank_p95(log, window).first().p95 == 1000


def test_metric_statistics_and_producers(spark):
    series = spark.createDataFrame(
        [("m", {"job": "a", "i": "1"}), ("m", {"job": "a", "i": "2"}), ("m", {"i": "3"}), ("n", {"job": "b"})],
        "name string, labels map<string,string>",
    )
    producers = reads.metric_producers(series, "m")
    assert [(r.job, r.series) for r in producers.collect()] == [("a", 2)]
    assert reads.producer_contribution(producers).first().percent == 100
    assert reads.series_shape(series, "m").first().asDict() == {"serie_count": 3, "label_count": 3}
    assert reads.series_shape(series, "x").first().asDict() == {"serie_count": 0, "label_count": 0}


def test_latest_records_need_no_sort(make_log):
    day = BASE.replace(hour=3)
    log = make_log(
        {"query_id": 5, "ts": day, "fingerprint": "a"},
        {"query_id": 9, "ts": day, "fingerprint": "a"},
        {"query_id": 7, "ts": BASE, "fingerprint": "a"},
        {"query_id": 8, "ts": BASE, "fingerprint": ""},
        {"query_id": 2, "ts": BASE, "fingerprint": None},
    )
    latest = reads.latest_by_fingerprint(log)
    assert sorted((str(r.fingerprint), r.query_id) for r in latest.collect()) == [("", 8), ("None", 2), ("a", 9)]
    assert latest.columns == log.columns
    plan = plan_of(reads.latest_by_fingerprint(log))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
