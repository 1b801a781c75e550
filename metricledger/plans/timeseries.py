"""Bucketed series over the query log.

All of them bin ``[start, end)`` of the window by arithmetic and join a zero-filled spine. A
bucket that holds a large share of the rows costs nothing extra: the aggregates combine on the
map side, and the exact percentile works on counts per (bucket, duration).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import percent
from metricledger.functions.scalars import range_seconds
from metricledger.operators import buckets as B
from metricledger.operators import filters as flt
from metricledger.params import TimeRange

DAY = 86_400
# Label and lower bound, in days, of the range classes.
RANGE_CLASSES = (("<24h", 0), ("24h", 1), ("7d", 7), ("30d", 30), ("60d", 60), ("90d+", 90))


def _window(log: DataFrame, tr: TimeRange, fingerprint: str | None = None, metric: str | None = None) -> DataFrame:
    rows = flt.time_filter(log, tr, half_open=True)
    rows = flt.by_fingerprint(rows, fingerprint)
    return B.with_bucket(flt.references_metric(rows, metric), tr)


def _series(log: DataFrame, tr: TimeRange, agg: DataFrame) -> DataFrame:
    return B.on_spine(B.time_spine(log.sparkSession, tr), agg)


def _per_bucket(log: DataFrame, tr: TimeRange, rows: DataFrame, **aggregates: Column) -> DataFrame:
    agg = rows.groupBy("idx").agg(*[c.alias(name) for name, c in aggregates.items()])
    return _series(log, tr, agg)


def status_distribution(log: DataFrame, tr: TimeRange, fingerprint: str | None = None) -> DataFrame:
    """time, status_2xx, status_4xx, status_5xx."""
    code = F.col("status_code")
    return _per_bucket(
        log,
        tr,
        _window(log, tr, fingerprint),
        status_2xx=F.count_if(code.between(200, 299)),
        status_4xx=F.count_if(code.between(400, 499)),
        status_5xx=F.count_if(code.between(500, 599)),
    )


def throughput(log: DataFrame, tr: TimeRange) -> DataFrame:
    return _per_bucket(log, tr, _window(log, tr), value=F.count(F.lit(1)))


def errors_over_time(log: DataFrame, tr: TimeRange, fingerprint: str | None = None) -> DataFrame:
    return _per_bucket(log, tr, _window(log, tr, fingerprint), value=F.count_if(F.col("status_code") >= 400))


def _duration_counts(rows: DataFrame, key: str) -> DataFrame:
    """Rows per (key, duration) with running and total counts per key.

    Only distinct durations reach the window, which sorts and spills; the rows themselves have
    been counted before the shuffle.
    """
    counts = (
        rows.where(F.col("duration_ms").isNotNull())
        .groupBy(key, "duration_ms")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_key = Window.partitionBy(key)
    running = by_key.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({"upto": F.sum("n").over(running), "total": F.sum("n").over(by_key)})


def _interpolated(q: float) -> Column:
    """Continuous percentile from (duration, running count, total)."""
    rank = F.lit(q) * (F.max("total") - 1)
    position = F.lit(q) * (F.col("total") - 1)
    low = F.min(F.when(F.col("upto") > F.floor(position), F.col("duration_ms")))
    high = F.min(F.when(F.col("upto") > F.ceil(position), F.col("duration_ms")))
    return low + (high - low) * (rank - F.floor(rank))


def latency_trends(
    log: DataFrame,
    tr: TimeRange,
    metric: str | None = None,
    fingerprint: str | None = None,
    approx: bool = False,
) -> DataFrame:
    """time, value (average), p95. The exact percentile interpolates and drops its fraction."""
    rows = _window(log, tr, fingerprint, metric)
    if approx:
        return _per_bucket(
            log,
            tr,
            rows,
            value=F.round(F.avg("duration_ms"), 2),
            p95=F.percentile_approx("duration_ms", F.lit(0.95), F.lit(10_000)).cast("long"),
        )
    mean = F.sum(F.col("duration_ms") * F.col("n")) / F.max("total")
    agg = (
        _duration_counts(rows, "idx")
        .groupBy("idx")
        .agg(F.round(mean, 2).alias("value"), F.round(_interpolated(0.95), 2).cast("long").alias("p95"))
    )
    return _series(log, tr, agg)


def approx_rank_check(log: DataFrame, tr: TimeRange, stated: DataFrame | None = None, error: float = 1 / 10_000) -> DataFrame:
    """time, rank_within_bound: whether the stated p95 of each bucket is a duration whose ranks come within
    ``error`` n (and one row) of 0.95 n. Buckets without rows are. Without ``stated`` it is the approximate percentile."""
    stated = (latency_trends(log, tr, approx=True) if stated is None else stated).select("time", "p95")
    counts = _duration_counts(_window(log, tr), "idx")
    start = B.bucket_start(F.col("idx"), B.bucket_origin(tr), B.bucket_stride(tr)).alias("time")
    ranks = counts.select(start, F.col("duration_ms").alias("p95"), "upto", (F.col("upto") - F.col("n")).alias("below"), "total")
    target, slack = F.col("total") * F.lit(0.95), F.col("total") * F.lit(error) + 1
    within = (F.col("below") <= target + slack) & (F.col("upto") >= target - slack)
    empty = stated.join(counts.select(start).distinct(), "time", "left_anti").select("time", F.lit(True).alias("rank_within_bound"))
    filled = stated.join(counts.select(start).distinct(), "time", "left_semi").join(ranks, ["time", "p95"], "left")
    return filled.select("time", F.coalesce(within, F.lit(False)).alias("rank_within_bound")).unionByName(empty)


def rank_p95(log: DataFrame, tr: TimeRange) -> DataFrame:
    """minute, p95: the largest duration among the slowest five percent of each minute.

    Row ranks above ``int(0.95 * rows)`` are the slow ones. Ranks come from counts per duration,
    so no minute is sorted row by row.
    """
    minute = dt.timedelta(minutes=1)
    origin = B.bucket_origin(tr)
    rows = B.with_bucket(flt.time_filter(log, tr, half_open=True), tr, minute)
    slow = F.col("upto") > F.floor(F.col("total") * F.lit(0.95))
    agg = (
        _duration_counts(rows, "idx")
        .groupBy("idx")
        .agg(F.coalesce(F.max(F.when(slow, F.col("duration_ms"))), F.lit(0)).cast("long").alias("p95"))
    )
    return agg.select(B.bucket_start(F.col("idx"), origin, minute).alias("minute"), "p95")


def range_class(seconds: Column) -> Column:
    """Position of a range length among ``RANGE_CLASSES``."""
    out = F.lit(0)
    for position, (_, days) in enumerate(RANGE_CLASSES):
        out = F.when(seconds >= days * DAY, F.lit(position)).otherwise(out)
    return out


def labelled_union(counts: DataFrame, labels: list[str]) -> DataFrame:
    """(label, count) rows from one row of counts; a labelled UNION ALL without a scan per label."""
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(f"c{i}").alias("count"))
            for i, label in enumerate(labels)
        ]
    )
    extra = [c for c in counts.columns if c not in {f"c{i}" for i in range(len(labels))}]
    return counts.select(*extra, F.inline(rows))


def time_range_distribution(log: DataFrame, tr: TimeRange, fingerprint: str | None = None) -> DataFrame:
    """label, count, percent of range queries by how far back they look; all labels, in order."""
    rows = flt.by_fingerprint(flt.time_filter(log, tr), fingerprint).where(
        (F.col("type") == "range") & (F.col("end_ts") > F.col("start_ts"))
    )
    position = range_class(range_seconds(F.col("start_ts"), F.col("end_ts")))
    counts = rows.select(position.alias("p")).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("p") == i).alias(f"c{i}") for i in range(len(RANGE_CLASSES))],
    )
    share = F.coalesce(percent(F.col("count"), F.col("total")), F.lit(0.0))
    return labelled_union(counts, [label for label, _ in RANGE_CLASSES]).select(
        "label", "count", share.alias("percent")
    )


def retention_insight(distribution: DataFrame) -> DataFrame:
    """short, medium and long share with the advice tier they lead to; tier NULL without queries."""

    def share(*labels: str) -> Column:
        return F.round(F.sum(F.when(F.col("label").isin(*labels), F.col("percent")).otherwise(F.lit(0.0))), 2)

    total = distribution.agg(
        F.sum("count").alias("total"),
        share("<24h", "24h").alias("short_percent"),
        share("7d", "30d").alias("medium_percent"),
        share("60d", "90d+").alias("long_percent"),
    )
    tier = (
        F.when(F.col("total") == 0, F.lit(None).cast("string"))
        .when(F.col("short_percent") >= 70, F.lit("short"))
        .when(F.col("short_percent") + F.col("medium_percent") >= 80, F.lit("medium"))
        .when(F.col("long_percent") >= 40, F.lit("long"))
        .otherwise(F.lit("balanced"))
    )
    return total.select("short_percent", "medium_percent", "long_percent", tier.alias("tier"))
