"""Days of a streamed log: finished ones are moved into few sorted files, old ones go.

The stream writes folders by day and batch (``streamed``); closing a day moves it to a table of its own (``closed``), partitioned by
day, where rows keep their batch. Logs that are appended otherwise lie elsewhere and are not touched.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger.operators.maintenance import apply_retention
from metricledger.session import new_table_path
from metricledger.sources import folders
from metricledger.sources.query_log import identity_bloom


def _day(spark: SparkSession, path: str, day: dt.date) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/dt={day}")


def close_day(spark: SparkSession, streamed: str, closed: str, day: dt.date, by: Sequence[str] = ("ts",)) -> bool:
    """Moves a day's batches to ``closed``, sorted by the columns given; whether there was something to move.

    The streamed folder goes once the closed one is written, so a run that broke off is simply run again. A batch that the
    stream repeats after its day was closed takes the place of its rows when the day is closed again; other batches stay.
    """
    if not folders.exists(spark, f"{streamed}/dt={day}"):
        return False
    rows = _day(spark, streamed, day)
    if folders.exists(spark, f"{closed}/dt={day}"):
        kept = _day(spark, closed, day).join(rows.select("batch_id").distinct(), "batch_id", "left_anti")
        path = new_table_path(spark, "closing")  # a folder cannot be read while it is overwritten
        rows.unionByName(kept).write.parquet(path)
        rows = spark.read.parquet(path)
    writer = rows.hint("rebalance").sortWithinPartitions(*by).write.mode("overwrite")
    writer.options(partitionOverwriteMode="dynamic", **identity_bloom()).partitionBy("dt").parquet(closed)
    folders.remove(spark, f"{streamed}/dt={day}")
    return True


def close_finished(spark: SparkSession, streamed: str, closed: str, today: dt.date, by: Sequence[str] = ("ts",), keep: dt.timedelta | None = None) -> list[dt.date]:
    """Closes every day before ``today`` and gives those closed; with ``keep``, what lies further back is then deleted."""
    done = [day for day in folders.days(spark, streamed) if day < today and close_day(spark, streamed, closed, day, by)]
    if keep is not None and folders.days(spark, closed):
        apply_retention(spark, closed, dt.datetime.combine(today, dt.time()) - keep, ["dt"])
    return done


def read_streamed(spark: SparkSession, streamed: str, closed: str) -> DataFrame:
    """Open and closed days as one table. A batch found in both counts once, as streamed."""
    opened, done = folders.days(spark, streamed), folders.days(spark, closed)
    if not done:
        return spark.read.parquet(streamed)
    old = spark.read.parquet(closed)
    if not opened:
        return old
    new = spark.read.parquet(streamed)
    both = sorted(set(opened) & set(done))
    if both:  # a closing broke off, or a batch was repeated
        old = old.join(new.where(F.col("dt").isin(both)).select("dt", "batch_id").distinct(), ["dt", "batch_id"], "left_anti")
    return new.unionByName(old)
