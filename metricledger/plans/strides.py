"""Stored hierarchy of strides: counts and duration sketches of the log by minute, hour and day.

The table holds one row for each level, cell and value of the dimensions. All its measures add up and its sketches merge, so a
batch only appends the cells of its own rows; late records are deltas to cells that are there already. A batch has a folder for
each level, whatever its days, and one that is repeated overwrites its own folders. Files are sorted by time, so the bounds of their
row groups and pages tell which hold a day: folders by day would have to be committed and listed one after the other.

A read takes each bucket apart into the widest cells that lie in it whole. What is left of the first and the last minute of an unaligned
window comes from the log, so counts and averages equal those of the log. Only levels that can hold a cell of use are read, and of
them only the days that can: a filter pushed into the scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger.functions.scalars import epoch_seconds
from metricledger.operators import buckets as B
from metricledger.operators import filters as flt
from metricledger.params import TimeRange

#: Seconds of a cell, from the narrowest level on.
LEVELS = {"minute": 60, "hour": 3_600, "day": 86_400}
SUMS = ("total", "status_2xx", "status_4xx", "status_5xx", "errors", "duration_sum", "durations")
#: Size of the duration sketches. Up to so many durations a sketch is exact.
SKETCH_SIZE = 800
#: What a merged sketch's ranks may be off, as a share of its rows. The size gives less than half of it in 99 of 100 cases.
RANK_ERROR = 0.01
_EPOCH = dt.datetime(1970, 1, 1)
_MINUTE = dt.timedelta(minutes=1)
_PARTS = ("level", "batch")


def _floor(seconds: Column, width: int) -> Column:
    return seconds - F.pmod(seconds, F.lit(width))


def minute_cells(log: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Cells of the narrowest level. Sums and sketches are combined before the shuffle, so a crowded minute is spread over its tasks."""
    code = F.col("status_code")
    return log.groupBy(_floor(epoch_seconds(F.col("ts")), LEVELS["minute"]).alias("cell"), *dims).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(code.between(200, 299)).alias("status_2xx"),
        F.count_if(code.between(400, 499)).alias("status_4xx"),
        F.count_if(code.between(500, 599)).alias("status_5xx"),
        F.count_if(code >= 400).alias("errors"),
        F.sum("duration_ms").alias("duration_sum"),
        F.count("duration_ms").alias("durations"),
        F.kll_sketch_agg_bigint("duration_ms", SKETCH_SIZE).alias("sketch"),
    )


def merge_cells(cells: DataFrame, *keys: Column | str) -> DataFrame:
    """One row for each value of the keys: sums added, sketches merged."""
    return cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS], F.kll_merge_agg_bigint("sketch", SKETCH_SIZE).alias("sketch"))


def append(log: DataFrame, path: str, batch: int = 0, dims: Sequence[str] = ()) -> None:
    """Adds the cells of a batch of the log. The log is read once: every level is made from the written level below it."""
    spark, below = log.sparkSession, None
    for level, width in LEVELS.items():
        if below is None:
            cells = minute_cells(log, dims)
        else:
            written = read(spark, path).where((F.col("level") == below) & (F.col("batch") == batch))
            cells = merge_cells(written, _floor(F.col("cell"), width).alias("cell"), *dims)
        day = F.date_from_unix_date(F.floor(F.col("cell") / LEVELS["day"]).cast("int"))
        placed = cells.withColumns({"level": F.lit(level), "dt": day, "batch": F.lit(batch).cast("long")})
        writer = placed.hint("rebalance", "dt").sortWithinPartitions(*_PARTS, "dt", "cell", *dims).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(path)
        below = level


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))


def compact(strides: DataFrame, path: str, dims: Sequence[str] = ()) -> None:
    """The table with its deltas merged, as one batch in a new folder."""
    cells = merge_cells(strides, "level", "dt", "cell", *dims).withColumn("batch", F.lit(0).cast("long"))
    rows = cells.hint("rebalance", "level", "dt").sortWithinPartitions(*_PARTS, "dt", "cell", *dims)
    rows.write.mode("errorifexists").partitionBy(*_PARTS).parquet(path)


# ---- reads ------------------------------------------------------------------------------
def whole_minutes(tr: TimeRange) -> TimeRange | None:
    """The whole minutes of a window; None where it holds none."""
    start = tr.start.replace(second=0, microsecond=0)
    start = start if start == tr.start else start + _MINUTE
    end = tr.end.replace(second=0, microsecond=0)
    return TimeRange(start, end) if start < end else None


def _seconds(moment: dt.datetime) -> int:
    return (moment - _EPOCH) // dt.timedelta(seconds=1)


def _stored(strides: DataFrame, tr: TimeRange, inner: TimeRange) -> DataFrame:
    """The widest cells that lie whole in one bucket and in ``inner``."""
    base, stride = _seconds(B.bucket_origin(tr)), int(B.bucket_stride(tr).total_seconds())
    low, high = _seconds(inner.start), _seconds(inner.end)

    def fits(start: Column, width: int) -> Column:
        first, last = (F.floor((at - F.lit(base)) / F.lit(stride)) for at in (start, start + F.lit(width - 1)))
        return (start >= low) & (start + width <= high) & (first == last)

    parts = []
    levels = [(level, width) for level, width in LEVELS.items() if width <= stride]
    for i, (level, width) in enumerate(levels):
        days = F.col("dt").between(F.lit(inner.start.date()), F.lit(inner.end.date()))
        use = fits(F.col("cell"), width)
        if i + 1 < len(levels):
            wider = levels[i + 1][1]
            use = use & ~fits(_floor(F.col("cell"), wider), wider)
            if base % wider == 0 and stride % wider == 0:  # then only the ends of the window divide wider cells
                if low % wider == 0 and high % wider == 0:
                    continue
                days = F.col("dt").isin(inner.start.date(), inner.end.date())
        parts.append(strides.where((F.col("level") == level) & days & F.col("cell").between(low, high) & use))
    return reduce(DataFrame.unionByName, parts)


def cells_of(strides: DataFrame, log: DataFrame, tr: TimeRange, fingerprint: str | None = None) -> DataFrame:
    """Cells and ends of ``[start, end)``, each with the bucket ``idx`` that it lies in. A filter by fingerprint needs it as a dimension."""
    inner = whole_minutes(tr)
    ends = [tr] if inner is None else [e for e in (TimeRange(tr.start, inner.start), TimeRange(inner.end, tr.end)) if e.start < e.end]
    columns = ["cell", *SUMS, "sketch"]
    parts = [minute_cells(flt.by_fingerprint(flt.time_filter(log, e, half_open=True), fingerprint)).select(columns) for e in ends]
    if inner is not None:
        parts.append(flt.by_fingerprint(_stored(strides, tr, inner), fingerprint).select(columns))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    base, stride = _seconds(B.bucket_origin(tr)), int(B.bucket_stride(tr).total_seconds())
    return rows.withColumn("idx", F.floor((F.col("cell") - F.lit(base)) / F.lit(stride)).cast("long"))


def _series(strides: DataFrame, log: DataFrame, tr: TimeRange, fingerprint: str | None, **aggregates: Column) -> DataFrame:
    agg = cells_of(strides, log, tr, fingerprint).groupBy("idx").agg(*[c.alias(name) for name, c in aggregates.items()])
    return B.on_spine(B.time_spine(strides.sparkSession, tr), agg)


def status_distribution(strides: DataFrame, log: DataFrame, tr: TimeRange, fingerprint: str | None = None) -> DataFrame:
    """time, status_2xx, status_4xx, status_5xx."""
    return _series(strides, log, tr, fingerprint, **{c: F.sum(c) for c in ("status_2xx", "status_4xx", "status_5xx")})


def throughput(strides: DataFrame, log: DataFrame, tr: TimeRange) -> DataFrame:
    return _series(strides, log, tr, None, value=F.sum("total"))


def errors_over_time(strides: DataFrame, log: DataFrame, tr: TimeRange, fingerprint: str | None = None) -> DataFrame:
    return _series(strides, log, tr, fingerprint, value=F.sum("errors"))


def latency_trends(strides: DataFrame, log: DataFrame, tr: TimeRange, fingerprint: str | None = None) -> DataFrame:
    """time, value (average, exact), p95 from merged sketches: a duration whose ranks come within ``RANK_ERROR`` of it."""
    merged = F.kll_merge_agg_bigint(F.when(F.col("durations") > 0, F.col("sketch")), SKETCH_SIZE)
    p95 = F.when(F.sum("durations") > 0, F.kll_sketch_get_quantile_bigint(merged, F.lit(0.95)))
    return _series(strides, log, tr, fingerprint, value=F.round(F.sum("duration_sum") / F.sum("durations"), 2), p95=p95)
