"""Row filters of the reads. Empty parameters add no predicate at all."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import ntz
from metricledger.params import TimeRange

# Catalog types that belong to one family.
TYPE_FAMILIES = {
    "histogram": ("histogram_bucket", "histogram_count", "histogram_sum"),
    "summary": ("summary", "summary_count", "summary_sum"),
}
USAGE_STATES = ("all", "used", "unused")
COUNT_COLUMNS = ("alert_count", "record_count", "dashboard_count", "query_count")


def within(tr: TimeRange, ts: Column, half_open: bool = False) -> Column:
    upper = ts < ntz(tr.end) if half_open else ts <= ntz(tr.end)
    return (ts >= ntz(tr.start)) & upper


def time_filter(df: DataFrame, tr: TimeRange, half_open: bool = False, ts: str = "ts") -> DataFrame:
    """Rows of the window. A ``dt`` partition column gets the bounds that ``ts`` implies,
    which the optimizer cannot derive."""
    keep = within(tr, F.col(ts), half_open)
    if "dt" in df.columns:
        first, last = tr.start.date(), tr.end.date()
        keep = keep & F.col("dt").between(F.lit(first), F.lit(last))
    return df.where(keep)


def presence_overlap(df: DataFrame, tr: TimeRange) -> DataFrame:
    """Facts whose presence interval touches the window."""
    return df.where((F.col("first_seen_at") <= ntz(tr.end)) & (F.col("last_seen_at") >= ntz(tr.start)))


def ilike_any(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Case-insensitive substring on any of ``columns``; ``%`` and ``_`` in the text are wildcards."""
    if not text:
        return df
    keep = F.lit(False)
    for name in columns:
        keep = keep | F.col(name).ilike(f"%{text}%")
    return df.where(keep)


def by_fingerprint(df: DataFrame, fingerprint: str | None) -> DataFrame:
    return df.where(F.col("fingerprint") == fingerprint) if fingerprint else df


def selector_names(df: DataFrame) -> Column:
    """Metric name of every selector, in order, NULL for a nameless one.

    A stored log has them as a column of their own, which is far narrower than the matchers.
    """
    if "metric_names" in df.columns:
        return F.col("metric_names")
    return names_of(F.col("label_matchers"))


def names_of(matchers: Column) -> Column:
    return F.transform(matchers, lambda m: m["__name__"])


def references_metric(df: DataFrame, metric: str | None, match: str = "any") -> DataFrame:
    """Queries that name the metric in ``any`` selector or in the ``first``; no metric keeps all.

    On a metric log (a column ``metric``) this is a filter that reaches the scan; on a plain log the names of every row are tested.
    """
    if not metric:
        return df
    if "metric" in df.columns:
        return df.where((F.col("metric") == metric) & F.col("is_first") if match == "first" else F.col("metric") == metric)
    names = selector_names(df)
    return df.where(F.get(names, F.lit(0)) == metric if match == "first" else F.array_contains(names, metric))


def type_family(df: DataFrame, kind: str = "all") -> DataFrame:
    """``histogram`` and ``summary`` select their three catalog types; ``''`` the untyped rows."""
    if kind == "all":
        return df
    return df.where(F.col("type").isin(*TYPE_FAMILIES.get(kind, (kind,))))


def normalize_usage(state: str) -> str:
    cleaned = state.strip().lower()
    return cleaned if cleaned in USAGE_STATES else "all"


def is_used() -> Column:
    used = F.lit(False)
    for name in COUNT_COLUMNS:
        used = used | (F.coalesce(F.col(name), F.lit(0)) > 0)
    return used


def usage_state(df: DataFrame, state: str = "all") -> DataFrame:
    """``used`` looks at the counts, ``unused`` only at the evaluated flag."""
    state = normalize_usage(state)
    if state == "used":
        return df.where(is_used())
    if state == "unused":
        return df.where(F.coalesce(F.col("is_unused"), F.lit(False)))
    return df


def in_job(df: DataFrame, job_index: DataFrame, job: str) -> DataFrame:
    """Metrics that ``job`` exposes; ``''`` keeps all."""
    if not job:
        return df
    members = job_index.where(F.col("job") == job).select("name")
    return df.join(members, "name", "left_semi")


def before(df: DataFrame, cutoff: dt.datetime, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts) < ntz(cutoff))
