"""Reads over the query log, the usage tables and the series table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import percent
from metricledger.operators import filters as flt
from metricledger.operators.paging import Fetched, Order, Page, fetch_page, page_of
from metricledger.params import PageRequest, TimeRange


def _failed() -> Column:
    return F.col("status_code") >= 400


def query_types(log: DataFrame, tr: TimeRange, fingerprint: str | None = None) -> DataFrame:
    rows = flt.by_fingerprint(flt.time_filter(log, tr), fingerprint)
    total = F.count(F.lit(1))
    return rows.agg(
        total.alias("total"),
        percent(F.count_if(F.col("type") == "instant"), total).alias("instant_pct"),
        percent(F.count_if(F.col("type") == "range"), total).alias("range_pct"),
    )


def average_duration(log: DataFrame, tr: TimeRange, fingerprint: str | None = None) -> DataFrame:
    """Average of the window and its change, in percent, against the window before.

    One scan covers both windows; a row on their shared edge counts in both.
    """
    previous = tr.previous()
    rows = flt.by_fingerprint(flt.time_filter(log, TimeRange(previous.start, tr.end)), fingerprint)
    now = F.avg(F.when(flt.within(tr, F.col("ts")), F.col("duration_ms")))
    then = F.avg(F.when(flt.within(previous, F.col("ts")), F.col("duration_ms")))
    both = rows.agg(now.alias("now"), then.alias("then"))
    delta = F.round((F.col("now") - F.col("then")) * F.lit(100.0) / F.col("then"), 2)
    no_base = F.col("then").isNull() | (F.col("then") == 0)
    return both.select(
        F.round(F.coalesce(F.col("now"), F.lit(0.0)), 2).alias("avg_current"),
        F.when(no_base, F.lit(0.0)).otherwise(delta).alias("delta_percent"),
    )


def _rate_columns() -> list[Column]:
    total = F.count(F.lit(1))
    ok = F.count_if(F.col("status_code").between(200, 299))
    bad = F.count_if(_failed())
    return [
        ok.alias("success_total"),
        percent(ok, total).alias("success_pct"),
        bad.alias("error_total"),
        percent(bad, total).alias("error_pct"),
    ]


def query_rate(
    log: DataFrame, tr: TimeRange, metric: str | None = None, fingerprint: str | None = None
) -> DataFrame:
    rows = flt.by_fingerprint(flt.time_filter(log, tr), fingerprint)
    return flt.references_metric(rows, metric).agg(*_rate_columns())


def metric_query_performance(log: DataFrame, metric: str, tr: TimeRange) -> DataFrame:
    """Load a metric's queries cause, with their success and error rates."""
    rows = flt.references_metric(flt.time_filter(log, tr), metric)
    return rows.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.round(F.avg("total_queryable_samples"), 2).alias("average_samples"),
        F.max("peak_samples").alias("peak_samples"),
        F.round(F.avg("duration_ms"), 2).alias("average_duration"),
        *_rate_columns(),
    )


# ---- per expression ---------------------------------------------------------------------
def per_text(rows: DataFrame) -> DataFrame:
    """Counts per (fingerprint, text).

    All buffers are numbers, so this combines by hash on the map side, and what is shuffled
    onwards is one row per distinct text however often it ran.
    """
    return rows.groupBy("fingerprint", "query_param").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("duration_ms").alias("duration_sum"),
        F.count("duration_ms").alias("durations"),
        F.count_if(_failed()).alias("failures"),
        F.max("peak_samples").alias("peak"),
        F.max("ts").alias("last_ts"),
    )


def _latest_of_texts() -> Column:
    return F.max_by("query_param", F.struct("last_ts", "query_param"))


def expressions(log: DataFrame, tr: TimeRange, text_filter: str = "") -> DataFrame:
    """One row per fingerprint: latest text, executions, average duration, error rate, peak."""
    rows = flt.ilike_any(flt.time_filter(log, tr), ["query_param"], text_filter)
    runs = F.sum("runs")
    return (
        per_text(rows)
        .groupBy("fingerprint")
        .agg(
            _latest_of_texts().alias("query"),
            runs.alias("executions"),
            F.round(F.sum("duration_sum") / F.sum("durations"), 2).alias("avg_duration"),
            percent(F.sum("failures"), runs).alias("error_rate_pct"),
            F.max("peak").alias("peak_samples"),
        )
    )


EXPRESSION_SORTS = {
    "query": "query",
    "executions": "executions",
    "avgDuration": "avg_duration",
    "errorRatePercent": "error_rate_pct",
    "peakSamples": "peak_samples",
}


def _columns(sorts: dict[str, str]) -> dict[str, Column]:
    return {field: F.col(name) for field, name in sorts.items()}


def query_expressions(log: DataFrame, tr: TimeRange, request: PageRequest = PageRequest()) -> Page:
    rows = expressions(log, tr, request.filter)
    return page_of(rows, request, _columns(EXPRESSION_SORTS), "executions", ["fingerprint"])


def expression_order(request: PageRequest = PageRequest()) -> Order:
    return Order.of(_columns(EXPRESSION_SORTS), "executions", request, ["fingerprint"])


def fetch_expressions(log: DataFrame, tr: TimeRange, request: PageRequest = PageRequest(), after: tuple | None = None) -> Fetched:
    """One page of :func:`expressions` and their total in one pass over the log; ``after`` is the cursor of the page before."""
    return fetch_page(expressions(log, tr, request.filter), expression_order(request), request.size, after)


def _in_window(log: DataFrame, tr: TimeRange | None) -> DataFrame:
    return log if tr is None else flt.time_filter(log, tr)


def latest_text(log: DataFrame, tr: TimeRange | None = None) -> DataFrame:
    """(fingerprint, query): the text that ran last in the window; ties go to the larger text."""
    last = _in_window(log, tr).groupBy("fingerprint", "query_param").agg(F.max("ts").alias("last_ts"))
    return last.groupBy("fingerprint").agg(_latest_of_texts().alias("query"))


def executions_by_type(log: DataFrame, tr: TimeRange | None = None) -> DataFrame:
    """Executions per fingerprint and type, beside the fingerprint's latest text; the log is read once.

    Counts per text come first; the window over a fingerprint then holds its distinct texts and types, not its runs.
    """
    rows = _in_window(log, tr).groupBy("fingerprint", "query_param", "type")
    texts = rows.agg(F.count(F.lit(1)).alias("runs"), F.max("ts").alias("last_ts"))
    query = _latest_of_texts().over(Window.partitionBy("fingerprint")).alias("query")
    return texts.select("*", query).groupBy("fingerprint", "type", "query").agg(F.sum("runs").alias("executions"))


def latest_by_fingerprint(log: DataFrame, tr: TimeRange | None = None) -> DataFrame:
    """The latest whole record per fingerprint in the window; of several at that instant the one with the largest key.

    Instant and key are packed into one decimal, whose maximum hash aggregation can keep; a struct's it cannot, and would sort the log.
    The record is then fetched by its key.
    """
    rows = _in_window(log, tr)
    micros = F.unix_micros(F.col("ts").cast("timestamp")).cast("decimal(18,0)")
    packed = micros * F.lit("1" + "0" * 19).cast("decimal(20,0)") + F.col("query_id").cast("decimal(19,0)")
    last = rows.groupBy("fingerprint").agg(F.max(packed.cast("decimal(38,0)")).alias("_last"))
    keys = last.select(F.col("fingerprint").alias("_fingerprint"), "_last")
    same = (F.col("fingerprint").eqNullSafe(F.col("_fingerprint"))) & (packed.cast("decimal(38,0)") == F.col("_last"))
    return rows.join(keys, same).drop("_fingerprint", "_last")


EXECUTION_SORTS = {
    "ts": "ts",
    "duration": "duration_ms",
    "samples": "samples",
    "statusCode": "status_code",
    "type": "type",
    "steps": "steps",
}


def executions(log: DataFrame, tr: TimeRange, fingerprint: str, query_type: str = "") -> DataFrame:
    """Single executions of one fingerprint; an unknown type means both."""
    # '' is an identity of its own here: the invalid queries.
    rows = flt.time_filter(log, tr).where(F.col("fingerprint") == fingerprint)
    if query_type in ("instant", "range"):
        rows = rows.where(F.col("type") == query_type)
    key = ["query_id"] if "query_id" in log.columns else []
    return rows.select(
        *key,
        "ts",
        "status_code",
        "duration_ms",
        F.col("total_queryable_samples").alias("samples"),
        "type",
        F.coalesce(F.col("step"), F.lit(0.0)).alias("steps"),
        "http_headers",
        "start_ts",
        "end_ts",
    )


def query_executions(
    log: DataFrame, tr: TimeRange, fingerprint: str, request: PageRequest = PageRequest(), query_type: str = ""
) -> Page:
    rows = executions(log, tr, fingerprint, query_type)
    ties = [c for c in ("ts", "query_id") if c in rows.columns]
    return page_of(rows, request, _columns(EXECUTION_SORTS), "ts", ties)


METRIC_QUERY_SORTS = {
    "queryParam": "query",
    "avgDuration": "avg_duration",
    "avgPeakySamples": "avg_peak_samples",
    "maxPeakSamples": "max_peak_samples",
}


def metric_queries(log: DataFrame, metric: str, tr: TimeRange, text_filter: str = "") -> DataFrame:
    """Texts that name a metric in any selector, with their cost."""
    rows = flt.ilike_any(flt.time_filter(log, tr), ["query_param"], text_filter)
    return (
        flt.references_metric(rows, metric)
        .groupBy(F.col("query_param").alias("query"))
        .agg(
            F.avg("duration_ms").alias("avg_duration"),
            F.avg("peak_samples").alias("avg_peak_samples"),
            F.max("peak_samples").alias("max_peak_samples"),
        )
    )


def queries_by_metric(log: DataFrame, metric: str, tr: TimeRange, request: PageRequest = PageRequest()) -> Page:
    rows = metric_queries(log, metric, tr, request.filter)
    return page_of(rows, request, _columns(METRIC_QUERY_SORTS), "avgDuration", ["query"])


# ---- usage facts and series -------------------------------------------------------------
def metric_statistics(rules: DataFrame, dashboards: DataFrame, metric: str, tr: TimeRange) -> DataFrame:
    """Rules and dashboards of one metric beside all of them; dashboards count by name."""
    mine = F.col("serie") == metric
    alert, record = F.col("kind") == "alert", F.col("kind") == "record"
    rule_counts = flt.presence_overlap(rules, tr).agg(
        F.count_if(mine & alert).alias("alert_count"),
        F.count_if(mine & record).alias("record_count"),
        F.count_if(alert).alias("total_alerts"),
        F.count_if(record).alias("total_records"),
    )
    # One row per dashboard name first, so that the final counts are plain sums.
    names = flt.presence_overlap(dashboards, tr).groupBy("name").agg(F.max(mine).alias("mine"))
    dashboard_counts = names.agg(
        F.struct(F.count_if("mine").alias("dashboard_count"), F.count("name").alias("total_dashboards"))
    )
    return rule_counts.withColumn("d", dashboard_counts.scalar()).select(
        "alert_count", "record_count", "d.dashboard_count", "total_alerts", "total_records", "d.total_dashboards"
    )


def metric_producers(series: DataFrame, metric: str) -> DataFrame:
    """(job, series) of a metric; series without a job label are no producer's."""
    return (
        series.where((F.col("name") == metric) & F.col("labels")["job"].isNotNull())
        .groupBy(F.col("labels")["job"].alias("job"))
        .agg(F.count(F.lit(1)).alias("series"))
    )


def series_shape(series: DataFrame, metric: str) -> DataFrame:
    """(serie_count, label_count) of a metric; the name counts as a label."""
    mine = series.where(F.col("name") == metric)
    keys = mine.select(F.explode(F.map_keys("labels")).alias("label")).distinct()
    labels = keys.where(F.col("label") != "__name__").agg(F.count(F.lit(1)))
    named = F.when(F.col("serie_count") > 0, labels.scalar() + 1).otherwise(F.lit(0))
    return mine.agg(F.count(F.lit(1)).alias("serie_count")).withColumn("label_count", named.cast("long"))


def producer_contribution(producers: DataFrame) -> DataFrame:
    """Whole percent of the series each job holds; halves round up."""
    total = producers.agg(F.sum("series")).scalar()
    share = F.floor(F.col("series") / total * 100 + F.lit(0.5)).cast("long")
    return producers.select("job", "series", share.alias("percent"))


def list_jobs(job_index: DataFrame) -> DataFrame:
    return job_index.select("job").distinct().orderBy("job")
