"""Retention of the query log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import ntz


def retained(log: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Rows that stay; whole days before the cutoff are skipped by their partition."""
    rows = log.where(F.col("ts") >= ntz(cutoff))
    return rows.where(F.col("dt") >= F.lit(cutoff.date())) if "dt" in log.columns else rows


def retention_report(log: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """deleted, kept."""
    old = F.col("ts") < ntz(cutoff)
    return log.agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept"))


def apply_retention(spark: SparkSession, path: str, cutoff: dt.datetime, parts: Sequence[str] | None = None) -> int:
    """Delete rows before ``cutoff`` from a log partitioned by day (and batch); returns how many.

    ``parts`` names the folders; by default the log has some for the batch if it has such a column.

    Days before the cutoff's go as whole folders, counted without reading a column. Only the cutoff's own day is read and
    rewritten, as a dynamic partition overwrite, whose new files replace the old ones at commit.
    """
    log = spark.read.parquet(path)
    parts = list(parts or [c for c in ("dt", "batch_id") if c in log.columns])
    day = F.lit(cutoff.date())
    # one row a day, and one a batch of the cutoff's day
    days = log.where(F.col("dt") < day).groupBy("dt").count().collect()
    old = F.col("ts") < ntz(cutoff)
    edge = log.where(F.col("dt") == day)
    touched = edge.groupBy(*parts).agg(F.count_if(old).alias("gone"), F.count_if(~old).alias("left")).where("gone > 0").collect()
    if any(r.left for r in touched):
        kept = edge.where(~old)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    folders = [f"dt={r.dt}" for r in days] + ["/".join(f"{c}={r[c]}" for c in parts) for r in touched if not r.left]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for name in folders:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
    return sum(r["count"] for r in days) + sum(r.gone for r in touched)
