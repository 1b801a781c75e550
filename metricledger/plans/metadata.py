"""Series metadata listings: catalog rows with their usage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricledger.operators import filters as flt
from metricledger.operators.filters import COUNT_COLUMNS
from metricledger.operators.paging import MAX_METADATA_SIZE, Page, page_of
from metricledger.params import PageRequest
from metricledger.sources.text_index import TextIndex

METADATA_SORTS = {
    "name": "name",
    "type": "type",
    "help": "help",
    "unit": "unit",
    "alertCount": "alert_count",
    "recordCount": "record_count",
    "dashboardCount": "dashboard_count",
    "queryCount": "query_count",
}
_CATALOG = ["name", "type", "help", "unit"]


def _described(joined: DataFrame) -> DataFrame:
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in COUNT_COLUMNS]
    return joined.select(*_CATALOG, *counts, "last_queried_at")


def _catalog_rows(catalog: DataFrame | TextIndex, text: str, kind: str) -> DataFrame:
    found = catalog.search(text) if isinstance(catalog, TextIndex) else flt.ilike_any(catalog, ["name", "help"], text)
    return flt.type_family(found, kind).select(*_CATALOG)


def metadata_rows(
    catalog: DataFrame | TextIndex,
    summary: DataFrame,
    job_index: DataFrame | None = None,
    text: str = "",
    kind: str = "all",
    usage: str = "all",
    job: str = "",
) -> DataFrame:
    """Catalog rows with usage counts; a text is looked up where the catalog is given by its index. ``unused`` starts from the flag, and with a job from the
    job's metrics, so that the small side leads."""
    usage = flt.normalize_usage(usage)
    rows = _catalog_rows(catalog, text, kind)
    if usage == "unused":
        flagged = summary.where(F.col("is_unused"))
        if job:
            members = job_index.where(F.col("job") == job).select("name")
            flagged = members.join(flagged, "name")
        return _described(flagged.join(rows, "name"))
    if job:
        rows = flt.in_job(rows, job_index, job)
    joined = rows.join(summary.select("name", *COUNT_COLUMNS, "last_queried_at"), "name", "left")
    return _described(flt.usage_state(joined, usage))


def series_metadata(
    catalog: DataFrame | TextIndex,
    summary: DataFrame,
    job_index: DataFrame | None,
    request: PageRequest = PageRequest(sort_by="queryCount"),
    kind: str = "all",
    usage: str = "all",
    job: str = "",
) -> Page:
    """One page. Unused rows all count zero, so they are always listed by name."""
    rows = metadata_rows(catalog, summary, job_index, request.filter, kind, usage, job)
    default = "queryCount"
    if flt.normalize_usage(usage) == "unused":
        request = PageRequest(request.page, request.size, "name", request.order, request.filter)
        default = "name"
    fields = {field: F.col(name) for field, name in METADATA_SORTS.items()}
    return page_of(rows, request, fields, default, ["name"], cap=MAX_METADATA_SIZE)


def _named(df: DataFrame, names: Sequence[str] | DataFrame) -> DataFrame:
    if not isinstance(names, DataFrame):
        names = df.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return df.join(names.select("name").distinct(), "name", "left_semi")


def metadata_by_names(
    catalog: DataFrame,
    summary: DataFrame,
    names: Sequence[str] | DataFrame,
    job_index: DataFrame | None = None,
    job: str = "",
) -> DataFrame:
    """Metadata, counts and the unused flag for a list of names; never evaluated means not unused."""
    rows = _named(catalog, names).select(*_CATALOG)
    if job:
        rows = flt.in_job(rows, job_index, job)
    joined = rows.join(summary.select("name", *COUNT_COLUMNS, "last_queried_at", "is_unused"), "name", "left")
    counts = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in COUNT_COLUMNS]
    flag = F.coalesce(F.col("is_unused"), F.lit(False)).alias("is_unused")
    return joined.select(*_CATALOG, *counts, "last_queried_at", flag)


def metrics_unused(
    catalog: DataFrame,
    summary: DataFrame,
    names: Sequence[str] | DataFrame,
    job_index: DataFrame | None = None,
    job: str = "",
) -> DataFrame:
    """name, unused and the counts. Here ``unused`` is recomputed from the counts, so a metric that
    was never evaluated reads as unused; the flag of :func:`metadata_by_names` does not."""
    unused: Column = ~flt.is_used()
    rows = metadata_by_names(catalog, summary, names, job_index, job)
    return rows.select("name", unused.alias("unused"), *COUNT_COLUMNS)
