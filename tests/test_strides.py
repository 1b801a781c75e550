"""Reads from stored strides and counts by day against the log."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from metricledger import fixtures as fx
from metricledger.operators import buckets
from metricledger.params import TimeRange
from metricledger.plans import strides, summary, timeseries
from tests.conftest import BASE, plan_of

NIGHT = TimeRange.of("2024-01-05T00:00:00", "2024-03-05T00:00:00")


def rows(df):
    return [tuple(r) for r in df.collect()]


def random_windows(n):
    """Windows of all strides, with ends of every alignment."""
    rnd = random.Random(7)
    units = (1, 60, 3_600, 86_400)
    out = []
    for i in range(n):
        unit = units[i % 4]
        start = fx.FULL.start + dt.timedelta(seconds=rnd.randrange(10 * 86_400) // unit * unit)
        length = rnd.choice([30, 4_000, 20_000, 80_000, 500_000, 2_000_000, 5_000_000])
        out.append(TimeRange(start, start + dt.timedelta(seconds=max(length // unit * unit, 1))))
    return out


@pytest.mark.parametrize("tr", random_windows(8), ids=str)
def test_strides_equal_the_log(spark, sf, tr):
    log, cells = fx.query_log(spark, sf), fx.log_strides(spark, sf)
    assert rows(strides.status_distribution(cells, log, tr)) == rows(timeseries.status_distribution(log, tr))
    got, want = strides.latency_trends(cells, log, tr), timeseries.latency_trends(log, tr)
    assert rows(got.select("time", "value")) == rows(want.select("time", "value"))
    assert timeseries.approx_rank_check(log, tr, got, strides.RANK_ERROR).where("NOT rank_within_bound").count() == 0


def test_widest_cells_tile_the_window(spark, sf):
    """Every second of the whole minutes is covered once, and whole days come as days."""
    tr = TimeRange.of("2024-01-02T22:58:10", "2024-03-10T01:02:30")
    whole = strides.whole_minutes(tr)
    seconds = int((tr.end - tr.start).total_seconds()) + 200_000
    start = int((tr.start - dt.datetime(1970, 1, 1)).total_seconds()) // 86_400 * 86_400
    levels = []
    for level, width in strides.LEVELS.items():
        cell = (F.col("id") * width + start).alias("cell")
        levels.append(spark.range(seconds // width).select(cell, F.lit(level).alias("level"), F.date_from_unix_date(F.floor((F.col("id") * width + start) / 86_400).cast("int")).alias("dt")))
    every = levels[0].unionByName(levels[1]).unionByName(levels[2])
    for window, counts in ((tr, None), (NIGHT, {"day"})):
        inner = strides.whole_minutes(window)
        used = strides._stored(every, window, inner).collect()
        spans = sorted((r.cell, r.cell + strides.LEVELS[r.level]) for r in used)
        low, high = ((t - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1) for t in (inner.start, inner.end))
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert (spans[0][0], spans[-1][1]) == (low, high)
        if counts:
            assert {r.level for r in used} == counts
    assert whole.start == dt.datetime(2024, 1, 2, 22, 59) and whole.end == dt.datetime(2024, 3, 10, 1, 2)


def test_aligned_window_reads_no_log(spark, sf):
    plan = plan_of(strides.throughput(fx.log_strides(spark, sf), fx.query_log(spark, sf), NIGHT))
    assert plan.count("FileScan") == 1 and "level" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_late_records_and_repeated_batches(spark, make_log, tmp_path):
    at = BASE + dt.timedelta(hours=3, seconds=7)
    first = make_log({"ts": at, "duration_ms": 10}, {"ts": at, "status_code": 500, "duration_ms": None})
    late = make_log({"ts": at, "duration_ms": 30}, {"ts": at - dt.timedelta(days=2)})
    path, merged = str(tmp_path / "strides"), str(tmp_path / "merged")
    for batch, log in ((0, first), (1, late), (1, late), (0, first)):
        strides.append(log, path, batch, ["fingerprint"])
    strides.compact(strides.read(spark, path), merged, ["fingerprint"])
    log = first.unionByName(late)
    tr = TimeRange(BASE - dt.timedelta(days=3), BASE + dt.timedelta(days=1))
    for cells in (strides.read(spark, path), strides.read(spark, merged)):
        assert rows(strides.errors_over_time(cells, log, tr)) == rows(timeseries.errors_over_time(log, tr))
        assert rows(strides.latency_trends(cells, log, tr).select("time", "value")) == rows(timeseries.latency_trends(log, tr).select("time", "value"))
        assert rows(strides.throughput(cells, log, tr)) == rows(timeseries.throughput(log, tr))
        assert strides.status_distribution(cells, log, tr, "other").agg(F.sum("status_2xx")).first()[0] == 0
    assert strides.read(spark, merged).count() == 3 * 2 < strides.read(spark, path).count()


def test_folders_do_not_grow_with_days(spark, make_log, tmp_path):
    """A batch of many days is committed in one folder for each level, and a read pushes its days into the scan."""
    path = str(tmp_path / "strides")
    strides.append(make_log(*[{"ts": BASE + dt.timedelta(days=d)} for d in range(40)]), path)
    assert sorted(str(p.relative_to(path)) for p in tmp_path.glob("strides/*/*") if p.is_dir()) == sorted(f"level={level}/batch=0" for level in strides.LEVELS)
    tr = TimeRange(BASE + dt.timedelta(days=3), BASE + dt.timedelta(days=33, hours=5, minutes=7))
    used = strides._stored(strides.read(spark, path), tr, tr)
    plan = spark._jvm.PythonSQLUtils.explainString(used._jdf.queryExecution(), "formatted")
    pushed = [line for line in plan.splitlines() if line.startswith("PushedFilters")]
    assert pushed and all("GreaterThanOrEqual(dt" in p or "In(dt" in p for p in pushed)
    assert sorted(r.dt - BASE.date() for r in used.collect()) == [dt.timedelta(days=d) for d in range(3, 34)]


def test_empty_log(spark, make_log, tmp_path):
    path = str(tmp_path / "strides")
    strides.append(make_log({"ts": BASE}), path)
    tr = TimeRange(BASE + dt.timedelta(days=1), BASE + dt.timedelta(days=1, hours=2))
    got = rows(strides.latency_trends(strides.read(spark, path), make_log(), tr))
    assert len(got) == buckets.bucket_count(tr, buckets.bucket_stride(tr)) and {r[1:] for r in got} == {(0.0, 0)}


@pytest.mark.parametrize("hours", [0, 5, 24, 29.5, 100])
def test_counts_by_day_follow_a_sliding_window(spark, sf, hours):
    log, days = fx.query_log(spark, sf), fx.daily_counts(spark, sf)
    start = fx.FULL.start + dt.timedelta(hours=hours)
    for length in (dt.timedelta(hours=7), dt.timedelta(days=6)):
        tr = TimeRange(start, start + length)
        assert sorted(rows(summary.query_counts(log, tr, days))) == sorted(rows(summary.query_counts(log, tr)))


def test_counts_by_day_read_only_cut_days_of_the_log(spark, sf):
    tr = TimeRange.of("2024-01-03T05:00:00", "2024-01-20T00:00:00")
    counts = summary.query_counts(fx.query_log(spark, sf), tr, fx.daily_counts(spark, sf))
    plan = spark._jvm.PythonSQLUtils.explainString(counts._jdf.queryExecution(), "formatted")
    kept = [line for line in plan.splitlines() if line.startswith("PartitionFilters")]
    assert len(kept) == 2 and all("2024-01-04" in k and "2024-01-19" in k for k in kept)
    assert sum(" OR " in k for k in kept) == 1
