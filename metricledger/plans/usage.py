"""Rule and dashboard usage listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricledger.operators import filters as flt
from metricledger.operators.paging import Page, page_of
from metricledger.operators.upserts import latest
from metricledger.params import PageRequest, TimeRange

RULE_SORTS = ("name", "group_name", "expression", "created_at")
DASHBOARD_SORTS = ("name", "url", "created_at")


def _rules_in(rules: DataFrame, tr: TimeRange, kind: str, serie: str | None, text: str) -> DataFrame:
    rows = flt.presence_overlap(rules, tr).where(F.col("kind") == kind)
    if serie is not None:
        rows = rows.where(F.col("serie") == serie)
    return flt.ilike_any(rows, ["name", "expression"], text)


def rules_latest(
    rules: DataFrame, tr: TimeRange, kind: str, serie: str | None = None, text: str = ""
) -> DataFrame:
    """Latest version of each rule; of one metric, or of all of them."""
    versions = latest(
        _rules_in(rules, tr, kind, serie, text),
        ["serie", "kind", "group_name", "name"],
        [F.col("last_seen_at").desc(), F.col("expression"), F.array_join("labels", ",")],
    )
    return versions.select("serie", "group_name", "name", "expression", "kind", "labels", "created_at")


def rules_usage(
    rules: DataFrame, tr: TimeRange, kind: str, serie: str, request: PageRequest = PageRequest()
) -> Page:
    total = (
        _rules_in(rules, tr, kind, serie, request.filter)
        .select("kind", "group_name", "name")
        .distinct()
        .agg(F.count(F.lit(1)).alias("total"))
    )
    rows = rules_latest(rules, tr, kind, serie, request.filter)
    fields = {c: F.col(c) for c in RULE_SORTS}
    return page_of(rows, request, fields, "created_at", ["serie", "group_name", "name"], counted=total)


def _dashboards_in(dashboards: DataFrame, tr: TimeRange, serie: str | None, text: str) -> DataFrame:
    rows = flt.presence_overlap(dashboards, tr)
    if serie is not None:
        rows = rows.where(F.col("serie") == serie)
    return flt.ilike_any(rows, ["name", "url"], text)


def dashboards_latest(
    dashboards: DataFrame, tr: TimeRange, serie: str | None = None, text: str = ""
) -> DataFrame:
    versions = latest(
        _dashboards_in(dashboards, tr, serie, text),
        ["serie", "id"],
        [F.col("last_seen_at").desc(), F.col("name"), F.col("url")],
    )
    return versions.select("id", "serie", "name", "url", "created_at")


def dashboard_usage(
    dashboards: DataFrame, tr: TimeRange, serie: str, request: PageRequest = PageRequest()
) -> Page:
    total = (
        _dashboards_in(dashboards, tr, serie, request.filter)
        .select("id")
        .distinct()
        .agg(F.count(F.lit(1)).alias("total"))
    )
    rows = dashboards_latest(dashboards, tr, serie, request.filter)
    fields = {c: F.col(c) for c in DASHBOARD_SORTS}
    return page_of(rows, request, fields, "created_at", ["serie", "id"], counted=total)
