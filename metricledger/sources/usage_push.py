"""Pushed usage facts: metric -> {alertRules, recordingRules, dashboards} as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricledger import schemas


def _per_metric(pushes: DataFrame, body_col: str) -> DataFrame:
    carried = [c for c in pushes.columns if c != body_col]
    return pushes.select(
        *carried, F.explode(F.from_json(F.col(body_col), schemas.USAGE_PUSH)).alias("serie", "usage")
    )


def flatten_rule_usage(pushes: DataFrame, body_col: str = "body") -> DataFrame:
    """One row per metric and rule, alerting and recording alike; other columns are carried.

    Both lists are joined inside the row, so a push is read and parsed once.
    """

    def rules(field: str, kind: str) -> Column:
        listed = F.coalesce(F.col(f"usage.{field}"), F.array())
        return F.transform(
            listed,
            lambda r: F.struct(
                r["group_name"].alias("group_name"),
                r["name"].alias("name"),
                r["expression"].alias("expression"),
                F.lit(kind).alias("kind"),
                F.array().cast("array<string>").alias("labels"),
            ),
        )

    carried = [c for c in pushes.columns if c != body_col]
    both = F.concat(rules("alertRules", "alert"), rules("recordingRules", "record"))
    return _per_metric(pushes, body_col).select(*carried, "serie", F.inline(both))


def flatten_dashboard_usage(pushes: DataFrame, body_col: str = "body") -> DataFrame:
    metrics = _per_metric(pushes, body_col)
    carried = [c for c in pushes.columns if c != body_col]
    return metrics.select(*carried, "serie", F.explode("usage.dashboards").alias("d")).select(
        *carried, "d.id", "serie", "d.name", "d.url"
    )
