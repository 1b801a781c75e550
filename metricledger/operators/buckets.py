"""Time buckets: adaptive stride, arithmetic binning and the zero-filled spine.

A bucket is a whole number, ``floor((ts - origin) / stride)``. Aggregates group by that number,
so joining them to the spine is an equi-join on a long, and timestamps are only built for the
spine rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import ntz
from metricledger.functions.scalars import epoch_seconds
from metricledger.params import TimeRange

# Window length up to which a stride applies.
STRIDES = (
    (dt.timedelta(hours=2), dt.timedelta(minutes=1)),
    (dt.timedelta(hours=6), dt.timedelta(minutes=5)),
    (dt.timedelta(hours=24), dt.timedelta(minutes=15)),
    (dt.timedelta(days=7), dt.timedelta(hours=1)),
    (dt.timedelta(days=30), dt.timedelta(hours=6)),
)
LONGEST_STRIDE = dt.timedelta(days=1)
_EPOCH = dt.datetime(1970, 1, 1)


def bucket_stride(tr: TimeRange) -> dt.timedelta:
    return next((stride for limit, stride in STRIDES if tr.length <= limit), LONGEST_STRIDE)


def bucket_origin(tr: TimeRange) -> dt.datetime:
    return tr.start.replace(second=0, microsecond=0)


def bucket_count(tr: TimeRange, stride: dt.timedelta) -> int:
    """Buckets from the window's first minute to its last, both included."""
    last = tr.end.replace(second=0, microsecond=0)
    return max((last - bucket_origin(tr)) // stride + 1, 0)


def assign_bucket(ts: Column, origin: dt.datetime, stride: dt.timedelta) -> Column:
    base = int((origin - _EPOCH).total_seconds())
    return F.floor((epoch_seconds(ts) - F.lit(base)) / F.lit(int(stride.total_seconds()))).cast("long")


def bucket_start(index: Column, origin: dt.datetime, stride: dt.timedelta) -> Column:
    seconds = int(stride.total_seconds())
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds).cast("decimal(18,6)"))
    return ntz(origin) + step * index


def time_spine(spark: SparkSession, tr: TimeRange, stride: dt.timedelta | None = None) -> DataFrame:
    """(idx, time) for every bucket of the window, filled or not."""
    stride = stride or bucket_stride(tr)
    index = spark.range(0, bucket_count(tr, stride), 1, 1).select(F.col("id").alias("idx"))
    return index.withColumn("time", bucket_start(F.col("idx"), bucket_origin(tr), stride))


def with_bucket(df: DataFrame, tr: TimeRange, stride: dt.timedelta | None = None, ts: str = "ts") -> DataFrame:
    return df.withColumn("idx", assign_bucket(F.col(ts), bucket_origin(tr), stride or bucket_stride(tr)))


def on_spine(spine: DataFrame, agg: DataFrame) -> DataFrame:
    """Spine rows with their aggregate, zero where there is none.

    The aggregate has at most one row per bucket, so its size is bounded by the spine's.
    """
    values = [c for c in agg.columns if c != "idx"]
    return (
        spine.join(agg, "idx", "left")
        .select("time", *[F.coalesce(F.col(c), F.lit(0).cast(agg.schema[c].dataType)).alias(c) for c in values])
        .orderBy("time")
    )
