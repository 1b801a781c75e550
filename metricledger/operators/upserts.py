"""Keyed maintenance as snapshot functions: (target, source) -> new target.

Each returns the whole new table, which the caller writes to a new version. Keys are unique on
both sides before a join, so no key can be hot there; duplicates in a push are combined on the
map side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricledger import schemas
from metricledger.functions.expr_tools import ntz
from metricledger.operators.filters import is_used

RULE_KEY = ["serie", "kind", "group_name", "name", "expression", "labels"]


def upsert_catalog(target: DataFrame, source: DataFrame) -> DataFrame:
    """New or replaced type, help, unit and sync time per name; the first sighting is kept.

    ``source`` has (name, type, help, unit, synced_at, seq); of a repeated name the row with
    the highest ``seq`` counts.
    """
    latest = source.groupBy("name").agg(
        F.max_by(F.struct("type", "help", "unit", "synced_at"), "seq").alias("new")
    )
    old = target.select("name", F.struct("type", "help", "unit", "first_seen_at", "last_synced_at").alias("old"))
    return old.join(latest, "name", "full_outer").select(
        "name",
        *[
            F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c)
            for c in ("type", "help", "unit")
        ],
        F.coalesce("old.first_seen_at", "new.synced_at").alias("first_seen_at"),
        F.coalesce("new.synced_at", "old.last_synced_at").alias("last_synced_at"),
    )


def missing_summary(catalog: DataFrame, summary: DataFrame) -> DataFrame:
    """Catalog names without a summary row."""
    return catalog.select("name").join(summary.select("name"), "name", "left_anti")


def add_placeholders(summary: DataFrame, names: DataFrame, now: dt.datetime) -> DataFrame:
    """Zero rows for names not yet in the summary, not unused until evaluated."""
    zero = F.lit(0).cast("long")
    fresh = missing_summary(names.select("name").distinct(), summary).select(
        "name",
        zero.alias("alert_count"),
        zero.alias("record_count"),
        zero.alias("dashboard_count"),
        zero.alias("query_count"),
        F.lit(None).cast("timestamp_ntz").alias("last_queried_at"),
        ntz(now).alias("updated_at"),
        F.lit(False).alias("is_unused"),
    )
    return summary.select(*schemas.USAGE_SUMMARY.names).unionByName(fresh)


def merge_summary(target: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Refreshed rows replace theirs; rows that were not evaluated stay as they are."""
    names = schemas.USAGE_SUMMARY.names
    kept = target.select(*names).join(refreshed.select("name"), "name", "left_anti")
    return kept.unionByName(refreshed.select(*names))


def backfill_is_unused(summary: DataFrame) -> DataFrame:
    """Derive the flag from the counts, for rows older than the flag."""
    return summary.withColumn("is_unused", ~is_used())


def upsert_job_index(target: DataFrame, source: DataFrame) -> DataFrame:
    names = schemas.JOB_INDEX.names
    both = target.select(*names).unionByName(source.select(*names))
    return both.groupBy("name", "job").agg(F.max("updated_at").alias("updated_at"))


def upsert_rules(target: DataFrame, source: DataFrame) -> DataFrame:
    """Presence intervals per rule; label order does not make a rule different.

    ``source`` has the six key columns and ``seen_at``.
    """
    old = target.select(*RULE_KEY, "created_at", "first_seen_at", "last_seen_at")
    seen = F.col("seen_at")
    new = source.withColumn("labels", F.array_sort(F.coalesce("labels", F.array()))).select(
        *RULE_KEY, seen.alias("created_at"), seen.alias("first_seen_at"), seen.alias("last_seen_at")
    )
    return (
        old.unionByName(new)
        .groupBy(*RULE_KEY)
        .agg(
            F.min("created_at").alias("created_at"),
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
        )
        .select(*schemas.RULES_USAGE.names)
    )


def upsert_dashboards(target: DataFrame, source: DataFrame) -> DataFrame:
    """Presence intervals per (id, serie); the latest push names the dashboard.

    ``source`` has (id, serie, name, url, seen_at, seq); ``seq`` orders pushes of one instant.
    """
    old = target.select(
        "id", "serie", "name", "url", "created_at", "first_seen_at", "last_seen_at", F.lit(-1).cast("long").alias("seq")
    )
    seen = F.col("seen_at")
    new = source.select(
        "id",
        "serie",
        "name",
        "url",
        seen.alias("created_at"),
        seen.alias("first_seen_at"),
        seen.alias("last_seen_at"),
        F.col("seq").cast("long").alias("seq"),
    )
    merged = (
        old.unionByName(new)
        .groupBy("id", "serie")
        .agg(
            F.max_by(F.struct("name", "url"), F.struct("last_seen_at", "seq")).alias("latest"),
            F.min("created_at").alias("created_at"),
            F.min("first_seen_at").alias("first_seen_at"),
            F.max("last_seen_at").alias("last_seen_at"),
        )
    )
    return merged.select(
        "id", "serie", "latest.name", "latest.url", "created_at", "first_seen_at", "last_seen_at"
    )


def latest(table: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in the given order; ranks are cut on the map side."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return table.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
