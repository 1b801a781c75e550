"""Usage summary: how often each catalog metric is used, and which are not."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import ntz
from metricledger.operators import filters as flt
from metricledger.operators.filters import COUNT_COLUMNS
from metricledger.params import TimeRange


def rule_counts(rules: DataFrame, tr: TimeRange) -> DataFrame:
    return (
        flt.presence_overlap(rules, tr)
        .groupBy(F.col("serie").alias("name"))
        .agg(
            F.count_if(F.col("kind") == "alert").alias("alert_count"),
            F.count_if(F.col("kind") == "record").alias("record_count"),
        )
    )


def dashboard_counts(dashboards: DataFrame, tr: TimeRange) -> DataFrame:
    """Distinct dashboard ids per metric; Spark reduces (metric, id) before it counts."""
    return (
        flt.presence_overlap(dashboards, tr)
        .groupBy(F.col("serie").alias("name"))
        .agg(F.count_distinct("id").alias("dashboard_count"))
    )


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    first = F.get(flt.selector_names(rows), F.lit(0)).alias("name")
    named = rows.select(first, "ts", *keys).where(F.col("name").isNotNull())
    return named.groupBy("name", *keys).agg(F.count(F.lit(1)).alias("query_count"), F.max("ts").alias("last_queried_at"))


def query_counts(log: DataFrame, tr: TimeRange, days: DataFrame | None = None) -> DataFrame:
    """Queries per metric of their first selector; the rest of the selectors do not count here.

    With ``days``, the table that :func:`append_daily_counts` keeps, the log is read for the days that the window cuts only.
    """
    if days is None:
        return _counted(flt.time_filter(log, tr))
    first = tr.start.date() if tr.start.time() == dt.time() else tr.start.date() + dt.timedelta(days=1)
    inner = F.col("dt").between(F.lit(first), F.lit(tr.end.date() - dt.timedelta(days=1)))
    ends = _counted(flt.time_filter(log, tr).where(~inner))
    rows = days.where(inner).select(ends.columns).unionByName(ends)
    return rows.groupBy("name").agg(F.sum("query_count").alias("query_count"), F.max("last_queried_at").alias("last_queried_at"))


def append_daily_counts(log: DataFrame, path: str, batch: int = 0) -> None:
    """Queries and last time per metric and day of a batch of the log. Late records are rows of their own for a day that is there
    already; a repeated batch overwrites its own folders."""
    rows = _counted(log, "dt").withColumn("batch", F.lit(batch).cast("long"))
    writer = rows.hint("rebalance", "dt").sortWithinPartitions("name").write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(path)


def usage_summary(
    catalog: DataFrame,
    rules: DataFrame,
    dashboards: DataFrame,
    log: DataFrame,
    tr: TimeRange,
    now: dt.datetime | None = None,
    days: DataFrame | None = None,
) -> DataFrame:
    """Recomputed summary rows of the metrics still synced within the window.

    The three inputs are aggregated by metric first, so every join is one row to one row. With the counts by day a
    refresh reads the new days, not the window.
    """
    joined = catalog.where(F.col("last_synced_at") >= ntz(tr.start)).select("name")
    for side in (rule_counts(rules, tr), dashboard_counts(dashboards, tr), query_counts(log, tr, days)):
        joined = joined.join(side, "name", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in COUNT_COLUMNS}
    return joined.select(
        "name",
        *[value.alias(c) for c, value in counts.items()],
        "last_queried_at",
        ntz(now or tr.end).alias("updated_at"),
        (~flt.is_used()).alias("is_unused"),
    )


def summary_noop_check(catalog: DataFrame, refreshed: DataFrame) -> DataFrame:
    """One row: did a refresh touch nothing although the catalog has rows?"""
    touched = refreshed.agg(F.count(F.lit(1))).scalar()
    suspicious = (F.col("refreshed_rows") == 0) & (F.col("catalog_rows") > 0)
    return (
        catalog.agg(F.count(F.lit(1)).alias("catalog_rows"))
        .withColumn("refreshed_rows", touched)
        .withColumn("was_noop", suspicious)
    )
