"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame.

Nested results are spelled as text, so that another engine can compare them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import partial
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger import fixtures as fx
from metricledger import schemas
from metricledger.functions import scalars
from metricledger.functions.expr_tools import ntz
from metricledger.operators import buckets, enrich, maintenance, otlp, paging, upserts
from metricledger.operators import filters as flt
from metricledger.operators.validate import check_queries
from metricledger.params import PageRequest, TimeRange
from metricledger.plans import inventory, metadata, reads, strides, summary, timeseries, usage
from metricledger.session import new_table_path
from metricledger.sources import catalog_feeds, query_log, usage_push
from metricledger.streaming import jobs, log_days

Query = Callable[[SparkSession, str], DataFrame]

FULL = fx.FULL
TWO_HOURS = TimeRange.of("2024-01-10T00:00:00", "2024-01-10T02:00:00")
ONE_DAY = TimeRange.of("2024-01-10T00:00:00", "2024-01-11T00:00:00")
UNALIGNED = TimeRange.of("2024-01-03T05:17:23", "2024-01-09T11:41:09")
MIDDLE = TimeRange.of("2024-01-10T00:00:00", "2024-01-20T00:00:00")
EMPTY = TimeRange.of("2023-01-01T00:00:00", "2023-02-01T00:00:00")

METRIC = "m_13_total"
NEXT_METRIC = "m_14_bucket"
JOB = "j3"
NAMES = ["m_4", "m_13_total", "m_14_count", "m_15_sum", "m_99", "not_there"]
FINGERPRINT = md5(b'm_13_total{env="MASKED",job="MASKED"}').hexdigest()[:16]
NOW = dt.datetime(2024, 2, 1)
CUTOFF = dt.datetime(2024, 1, 12, 7, 30)
ALLOW, DENY = ("j1", "j2", "j3", "svc0"), ("j2",)
DROP_NAMES, DROP_PREFIXES = ("m_4", "m_5_total"), ("m_11",)

#: What a batch of a stream of export trees takes, in bytes of its files; whatever is left comes with the next batches.
BATCH_BYTES = 512 << 20

_QUERIES: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        _QUERIES[name] = query
        return query

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def matchers_text(matchers: Column) -> Column:
    """``a=1,b=2;c=3``: labels sorted within a selector, selectors in order."""

    def selector(m: Column) -> Column:
        pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
        return F.array_join(F.array_sort(pairs), ",")

    return F.array_join(F.transform(matchers, selector), ";")


def map_text(m: Column) -> Column:
    pairs = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ",")


def _rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


# ---- sources and sinks ---------------------------------------------------------------------
@register("query_log_append")
def _query_log_append(spark, sf):
    log = fx.query_log(spark, sf)
    return log.select(
        "query_id",
        "ts",
        "query_param",
        "duration_ms",
        "status_code",
        "body_size",
        "type",
        "step",
        "start_ts",
        "end_ts",
        "total_queryable_samples",
        "peak_samples",
        "fingerprint",
        matchers_text(F.col("label_matchers")).alias("label_matchers"),
        F.col("http_headers")["user-agent"].alias("user_agent"),
        F.col("dt").cast("string").alias("dt"),
    )


def _push_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """The raw log as push bodies. Of 50 records one carries a field nobody knows, and each of ten others a value of a wrong type."""
    raw = fx.raw_query_log(spark, sf)
    q = F.col("query_id") % 50

    def spoilt(n: int, field: str, wrong: str) -> Column:
        """The member as JSON text would have it, replaced where the record's turn has come."""
        return F.when(q == n, F.lit(f'"{field}":{wrong}'))

    wrong = F.coalesce(*(spoilt(n, field, value) for n, (field, value) in enumerate(WRONG_FIELDS, 1)))
    record = F.struct(
        "query_param",
        _rfc3339(F.col("time_param")).alias("time_param"),
        (F.col("duration_ms") * 1_000_000).alias("duration"),
        "status_code",
        "body_size",
        "type",
        "step",
        _rfc3339(F.col("start_ts")).alias("start"),
        _rfc3339(F.col("end_ts")).alias("end"),
        "total_queryable_samples",
        "peak_samples",
        "http_headers",
        F.when(q == 0, F.lit("x")).alias("surprise"),
    )
    body = F.to_json(record)
    # of a field given twice the last one counts
    return raw.select(F.when(wrong.isNotNull(), F.concat(F.regexp_replace(body, r"\}$", ","), wrong, F.lit("}"))).otherwise(body).alias("value"))


WRONG_FIELDS = (
    ("body_size", '"abc"'),
    ("duration", '"5ms"'),
    ("peak_samples", "1.5"),
    ("start", '"garbage"'),
    ("time_param", '"garbage"'),
    ("time_param", '"1704067200"'),
    ("http_headers", '"x"'),
    ("query_param", "5"),
    ("step", '"15"'),
    ("status_code", "99999999999"),
)

_PUSHED = [
    "query_param",
    "time_param",
    "duration_ms",
    "status_code",
    "body_size",
    "type",
    "step",
    "start_ts",
    "end_ts",
    "total_queryable_samples",
    "peak_samples",
]


@register("query_push_read")
def _query_push_read(spark, sf):
    parsed = query_log.parse_query_push(_push_bodies(spark, sf))
    fine = F.coalesce(~F.col("error").startswith("invalid field"), F.lit(True))
    whole = ("int", "bigint")
    shown = [F.when(fine, F.col(c)).otherwise(F.lit(0 if kind in whole else None)).alias(c) for c, kind in parsed.select(*_PUSHED).dtypes]
    return parsed.select(*shown, F.when(fine, F.col("http_headers")["user-agent"]).alias("user_agent"), "error")


@register("query_validate")
def _query_validate(spark, sf):
    raw = fx.raw_query_log(spark, sf)
    q = F.col("query_id")
    spoiled = raw.withColumns(
        {
            "query_param": F.when(q % 31 == 1, F.lit("")).otherwise(F.col("query_param")),
            "body_size": F.when(q % 31 == 2, F.lit(-1)).otherwise(F.col("body_size")),
            "duration_ms": F.when(q % 31 == 3, F.lit(-5).cast("long")).otherwise(F.col("duration_ms")),
            "type": F.when(q % 31 == 4, F.lit("stream")).otherwise(F.col("type")),
            "status_code": F.when(q % 31 == 5, F.lit(299)).otherwise(F.col("status_code")),
            "step": F.when(q % 31 == 6, F.lit(-1.0)).otherwise(F.col("step")),
            "start_ts": F.when(q % 31 != 7, F.col("start_ts")),
            "end_ts": F.when(q % 31 == 8, F.col("start_ts") - F.make_dt_interval(F.lit(0), F.lit(1)))
            .when(q % 31 != 9, F.col("end_ts")),
        }
    )
    return check_queries(spoiled, ntz(NOW)).select("query_id", "error", "step", "start_ts", "end_ts")


@register("response_stats_parse")
def _response_stats_parse(spark, sf):
    raw = fx.raw_query_log(spark, sf)
    body = F.format_string(
        '{"status":"%s","data":{"resultType":"vector","stats":{"timings":{"evalTotalTime":0.1},'
        '"samples":{"totalQueryableSamples":%d,"peakSamples":%d}}}}',
        F.when(F.col("status_code") == 200, F.lit("success")).otherwise(F.lit("error")),
        "total_queryable_samples",
        "peak_samples",
    )
    replies = raw.select("query_id", body.alias("body"))
    return query_log.parse_response_stats(replies, "body").drop("body")


@register("usage_push_rules")
def _usage_push_rules(spark, sf):
    push = fx.rule_push(spark, sf)
    rule = F.array(F.struct("group_name", "name", "expression"))
    usage_of = F.struct(
        F.when(F.col("kind") == "alert", rule).alias("alertRules"),
        F.when(F.col("kind") == "record", rule).alias("recordingRules"),
    )
    bodies = push.select("seen_at", F.to_json(F.create_map("serie", usage_of)).alias("body"))
    return usage_push.flatten_rule_usage(bodies).drop("labels")


@register("rule_sources_union")
def _rule_sources_union(spark, sf):
    """Alerting and recording rules of every metric, counted by kind."""
    return _usage_push_rules(spark, sf).groupBy("serie", "kind").agg(F.count(F.lit(1)).alias("rules"))


@register("usage_push_dashboards")
def _usage_push_dashboards(spark, sf):
    push = fx.dashboard_push(spark, sf)
    usage_of = F.struct(F.array(F.struct("id", "name", "url")).alias("dashboards"))
    bodies = push.select("seen_at", F.to_json(F.create_map("serie", usage_of)).alias("body"))
    return usage_push.flatten_dashboard_usage(bodies)


@register("catalog_from_metadata")
def _catalog_from_metadata(spark, sf):
    return catalog_feeds.catalog_from_metadata(fx.metadata_push(spark, sf).drop("seq"))


@register("catalog_from_names")
def _catalog_from_names(spark, sf):
    names = fx.events(spark, sf).select(fx.metric_name(F.col("user_id")).alias("name"))
    return catalog_feeds.catalog_from_names(names)


@register("job_index_from_series")
def _job_index_from_series(spark, sf):
    return catalog_feeds.job_index_from_series(fx.series(spark, sf))


@register("otlp_flatten")
def _otlp_flatten(spark, sf):
    return otlp.flatten_otlp(fx.otlp_exports(spark, sf)).select(
        "export_id", "job", "metric_name", "data_type", "is_monotonic", "description", "unit", "points"
    )


@register("paged_result_write")
def _paged_result_write(spark, sf):
    page = reads.query_expressions(fx.query_log(spark, sf), FULL, PageRequest(page=2, size=20))
    return page.as_result().select(
        "total", "total_pages", F.array_join("data.fingerprint", ",").alias("fingerprints")
    )


# ---- enrichment and scalar functions --------------------------------------------------------
def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.expression_dictionary(fx.raw_query_log(spark, sf))


@register("fingerprint")
def _fingerprint(spark, sf):
    return _dictionary(spark, sf).select("query_param", "fingerprint")


@register("canonical_expr")
def _canonical_expr(spark, sf):
    return _dictionary(spark, sf).select("query_param", "canonical")


@register("canonical_expr_ignore_ranges")
def _canonical_any_range(spark, sf):
    return _dictionary(spark, sf).select("query_param", "canonical_any_range")


@register("label_matchers")
def _label_matchers(spark, sf):
    text = matchers_text(F.col("label_matchers")).alias("label_matchers")
    return _dictionary(spark, sf).select("query_param", text)


@register("metric_refs")
def _metric_refs(spark, sf):
    return enrich.metric_refs(fx.query_log(spark, sf))


@register("header_extract")
def _header_extract(spark, sf):
    ev = fx.events(spark, sf)
    request = F.create_map(
        F.lit("User-Agent"),
        F.concat(F.lit("client-"), F.col("user_id") % 5),
        F.lit("X-Team"),
        F.when(F.col("event_id") % 2 == 0, F.lit("a")).otherwise(F.lit("")),
    )
    response = F.create_map(F.lit("x-team"), F.lit("b"), F.lit("Server"), F.concat(F.lit("s"), F.col("k") % 3))
    picked = scalars.extract_headers(request, response, ["user-agent", "x-team", "server", "missing"])
    return ev.select("event_id", map_text(picked).alias("headers"))


@register("time_param_parse")
def _time_param_parse(spark, sf):
    ev = fx.events(spark, sf)
    seconds = scalars.epoch_seconds(F.col("ts"))
    text = (
        F.when(F.col("event_id") % 4 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 4 == 1, seconds.cast("string"))
        .when(F.col("event_id") % 4 == 2, F.concat(seconds.cast("string"), F.lit(".5")))
        .otherwise(F.lit("yesterday"))
    )
    return ev.select("event_id", scalars.parse_time_param(text, ntz(NOW)).alias("parsed"))


@register("status_class")
def _status_class(spark, sf):
    log = fx.query_log(spark, sf)
    return log.select("query_id", scalars.status_class(F.col("status_code")).alias("status_class"))


@register("range_seconds")
def _range_seconds(spark, sf):
    seconds = scalars.range_seconds(F.col("start_ts"), F.col("end_ts"))
    return fx.query_log(spark, sf).select("query_id", seconds.alias("seconds"))


@register("prom_metric_name")
def _prom_metric_name(spark, sf):
    return fx.otlp_metrics(spark, sf).select("metric_name", "data_type").distinct()


@register("otlp_type_map")
def _otlp_type_map(spark, sf):
    kind = scalars.otlp_prom_type(F.col("data_type"), F.col("is_monotonic"))
    return (
        fx.otlp_metrics(spark, sf)
        .groupBy("data_type", kind.alias("prom_type"))
        .agg(F.count(F.lit(1)).alias("metrics"))
    )


@register("otlp_catalog_items")
def _otlp_catalog_items(spark, sf):
    metrics = fx.otlp_metrics(spark, sf).select(
        "metric_name", "data_type", "is_monotonic", "description", "unit", "points", "job"
    )
    return otlp.otlp_catalog_items(metrics).groupBy("name", "type", "help", "unit").agg(
        F.count(F.lit(1)).alias("sightings")
    )


@register("resolve_job")
def _resolve_job(spark, sf):
    return fx.otlp_metrics(spark, sf).groupBy("job").agg(F.count(F.lit(1)).alias("metrics"))


# ---- filters --------------------------------------------------------------------------------
@register("time_filter")
def _time_filter(spark, sf):
    return flt.time_filter(fx.query_log(spark, sf), UNALIGNED, half_open=True).select("query_id", "ts")


@register("presence_overlap")
def _presence_overlap(spark, sf):
    rows = flt.presence_overlap(fx.dashboard_usage(spark, sf), TWO_HOURS)
    return rows.select("id", "serie", "first_seen_at", "last_seen_at")


@register("ilike_contains")
def _ilike_contains(spark, sf):
    return flt.ilike_any(fx.query_log(spark, sf), ["query_param"], "RATE(m%_total").select("query_id", "query_param")


@register("fingerprint_filter")
def _fingerprint_filter(spark, sf):
    return flt.by_fingerprint(fx.query_log(spark, sf), FINGERPRINT).select("query_id", "query_param")


@register("metric_match_any")
def _metric_match_any(spark, sf):
    return flt.references_metric(fx.metric_log(spark, sf), NEXT_METRIC, "any").select("query_id", "query_param")


@register("metric_match_first")
def _metric_match_first(spark, sf):
    return flt.references_metric(fx.metric_log(spark, sf), NEXT_METRIC, "first").select("query_id", "query_param")


@register("type_family_filter")
def _type_family_filter(spark, sf):
    return flt.type_family(fx.metrics_catalog(spark, sf), "summary").select("name", "type")


@register("usage_state_filter")
def _usage_state_filter(spark, sf):
    return flt.usage_state(fx.usage_summary(spark, sf), "used").select("name", *flt.COUNT_COLUMNS)


@register("job_membership")
def _job_membership(spark, sf):
    return flt.in_job(fx.metrics_catalog(spark, sf), fx.job_index(spark, sf), JOB).select("name", "type")


@register("name_list_lookup")
def _name_list_lookup(spark, sf):
    return metadata.metadata_by_names(fx.metrics_catalog(spark, sf), fx.usage_summary(spark, sf), NAMES)


# ---- joins ----------------------------------------------------------------------------------
def _metadata(spark: SparkSession, sf: str, **kwargs) -> DataFrame:
    return metadata.metadata_rows(
        fx.metrics_catalog(spark, sf), fx.usage_summary(spark, sf), fx.job_index(spark, sf), **kwargs
    )


register("series_metadata")(partial(_metadata, text="m_1"))


@register("series_metadata_indexed")
def _series_metadata_indexed(spark, sf):
    return metadata.metadata_rows(fx.text_index(spark, sf), fx.usage_summary(spark, sf), text="m_1")


@register("ilike_contains_indexed")
def _ilike_contains_indexed(spark, sf):
    return fx.text_index(spark, sf).search("M_1%_coU").select("name", "type", "help")


register("series_metadata_unused")(partial(_metadata, usage="unused"))
register("series_metadata_unused_job")(partial(_metadata, usage="unused", job=JOB))


@register("bucket_spine_join")
def _bucket_spine_join(spark, sf):
    return timeseries.throughput(fx.query_log(spark, sf), TWO_HOURS)


@register("bucket_range_join")
def _bucket_range_join(spark, sf):
    return timeseries.throughput(fx.query_log(spark, sf), UNALIGNED)


@register("scalar_cross_join")
def _scalar_cross_join(spark, sf):
    per_type = fx.query_log(spark, sf).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("executions"))
    return paging.with_total(per_type)


@register("missing_summary_backfill")
def _missing_summary_backfill(spark, sf):
    return upserts.missing_summary(fx.metrics_catalog(spark, sf), fx.usage_summary(spark, sf))


# ---- aggregations ---------------------------------------------------------------------------
def _on_log(read: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf: read(fx.query_log(spark, sf), *args, **kwargs)


def _on_metrics(read: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda spark, sf: read(fx.metric_log(spark, sf), *args, **kwargs)


register("query_types")(_on_log(reads.query_types, FULL))
register("query_types_empty")(_on_log(reads.query_types, EMPTY))
register("average_duration")(_on_log(reads.average_duration, MIDDLE))
register("query_rate")(_on_metrics(reads.query_rate, FULL, metric=METRIC))
register("query_status_distribution")(_on_log(timeseries.status_distribution, FULL))
register("query_status_distribution_day")(_on_log(timeseries.status_distribution, ONE_DAY))
register("query_latency_trends")(_on_log(timeseries.latency_trends, FULL))
register("query_latency_trends_metric")(_on_metrics(timeseries.latency_trends, UNALIGNED, metric=METRIC))
register("query_latency_trends_approx")(_on_log(timeseries.approx_rank_check, FULL))
register("query_throughput")(_on_log(timeseries.throughput, FULL))
register("query_throughput_empty")(_on_log(timeseries.throughput, EMPTY))
register("query_errors")(_on_log(timeseries.errors_over_time, FULL))
register("stride_status_distribution")(lambda spark, sf: strides.status_distribution(fx.log_strides(spark, sf), fx.query_log(spark, sf), UNALIGNED))
register("stride_throughput")(lambda spark, sf: strides.throughput(fx.log_strides(spark, sf), fx.query_log(spark, sf), FULL))
register("stride_errors")(lambda spark, sf: strides.errors_over_time(fx.log_strides(spark, sf), fx.query_log(spark, sf), UNALIGNED, FINGERPRINT))


@register("stride_latency_trends")
def _stride_latency_trends(spark, sf):
    """Averages from the stored cells, and whether the p95 of merged sketches keeps its stated rank error."""
    log = fx.query_log(spark, sf)
    trends = strides.latency_trends(fx.log_strides(spark, sf), log, UNALIGNED)
    return trends.select("time", "value").join(timeseries.approx_rank_check(log, UNALIGNED, trends, strides.RANK_ERROR), "time")


register("query_time_range_distribution")(_on_log(timeseries.time_range_distribution, FULL))
register("query_expressions")(_on_log(reads.expressions, FULL))


@register("query_expressions_keyset")
def _query_expressions_keyset(spark, sf):
    """The page behind the cursor of the first page, with the total that came along with the first."""
    log = fx.query_log(spark, sf)
    first = reads.fetch_expressions(log, FULL)
    return paging.keyset_page(reads.expressions(log, FULL), reads.expression_order(), 10, first.cursor).withColumn("total", F.lit(first.total).cast("long"))


register("metric_query_performance")(_on_metrics(reads.metric_query_performance, METRIC, FULL))
register("latest_query_text")(_on_log(reads.latest_text, MIDDLE))


@register("latest_text_lookup")
def _latest_text_lookup(spark, sf):
    """Executions per expression and type, beside the expression's latest text."""
    return reads.executions_by_type(fx.query_log(spark, sf), MIDDLE)


@register("query_executions")
def _query_executions(spark, sf):
    rows = reads.executions(fx.query_log(spark, sf), FULL, FINGERPRINT, "range")
    return rows.withColumn("http_headers", map_text(F.col("http_headers")))


@register("queries_by_metric")
def _queries_by_metric(spark, sf):
    rows = reads.metric_queries(fx.metric_log(spark, sf), NEXT_METRIC, FULL)
    return rows.withColumns({c: F.round(c, 6) for c in ("avg_duration", "avg_peak_samples")})


@register("metric_statistics")
def _metric_statistics(spark, sf):
    rules, dashboards = fx.rules_usage(spark, sf), fx.dashboard_usage(spark, sf)
    return reads.metric_statistics(rules, dashboards, "m_25_total", FULL)


@register("metric_producers")
def _metric_producers(spark, sf):
    return reads.metric_producers(fx.series(spark, sf), METRIC)


@register("metric_series_shape")
def _metric_series_shape(spark, sf):
    return reads.series_shape(fx.series(spark, sf), METRIC)


@register("producer_contribution")
def _producer_contribution(spark, sf):
    return reads.producer_contribution(reads.metric_producers(fx.series(spark, sf), METRIC))


@register("retention_insight")
def _retention_insight(spark, sf):
    return timeseries.retention_insight(timeseries.time_range_distribution(fx.query_log(spark, sf), FULL))


@register("metrics_unused")
def _metrics_unused(spark, sf):
    return metadata.metrics_unused(fx.metrics_catalog(spark, sf), fx.usage_summary(spark, sf), NAMES)


@register("adaptive_bucket")
def _adaptive_bucket(spark, sf):
    stride, origin = buckets.bucket_stride(UNALIGNED), buckets.bucket_origin(UNALIGNED)
    rows = flt.time_filter(fx.query_log(spark, sf), UNALIGNED, half_open=True)
    at = buckets.bucket_start(buckets.assign_bucket(F.col("ts"), origin, stride), origin, stride)
    return rows.select("query_id", at.alias("bucket"))


@register("rules_count_by_metric")
def _rules_count_by_metric(spark, sf):
    return summary.rule_counts(fx.rules_usage(spark, sf), MIDDLE)


@register("dashboards_count_by_metric")
def _dashboards_count_by_metric(spark, sf):
    return summary.dashboard_counts(fx.dashboard_usage(spark, sf), MIDDLE)


register("query_count_by_metric")(_on_log(summary.query_counts, MIDDLE))
register("query_count_by_metric_daily")(lambda spark, sf: summary.query_counts(fx.query_log(spark, sf), UNALIGNED, fx.daily_counts(spark, sf)))


@register("usage_summary")
def _usage_summary(spark, sf):
    return fx.refreshed_summary(spark, sf).drop("updated_at")


@register("usage_summary_refresh_join")
def _usage_summary_refresh_join(spark, sf):
    """The same over a window that part of the facts fall out of."""
    return fx.refreshed_summary(spark, sf, MIDDLE).drop("updated_at")


@register("list_jobs")
def _list_jobs(spark, sf):
    return reads.list_jobs(fx.job_index(spark, sf))


def _unused(spark: SparkSession, sf: str) -> DataFrame:
    return otlp.otlp_unused(fx.otlp_metrics(spark, sf), fx.usage_summary(spark, sf))


@register("otlp_point_counts")
def _otlp_point_counts(spark, sf):
    return otlp.point_counts(fx.otlp_metrics(spark, sf), fx.unused_names(spark, sf), ALLOW, DENY)


@register("missing_job_count")
def _missing_job_count(spark, sf):
    return otlp.missing_jobs(fx.otlp_metrics(spark, sf))


# ---- windows --------------------------------------------------------------------------------
@register("rules_latest")
def _rules_latest(spark, sf):
    rows = usage.rules_latest(fx.rules_usage(spark, sf), FULL, "alert")
    return rows.withColumn("labels", F.array_join("labels", ","))


@register("dashboards_latest")
def _dashboards_latest(spark, sf):
    return usage.dashboards_latest(fx.dashboard_usage(spark, sf), FULL)


@register("latest_by_fingerprint")
def _latest_by_fingerprint(spark, sf):
    rows = reads.latest_by_fingerprint(fx.query_log(spark, sf), MIDDLE)
    return rows.select("fingerprint", "query_id", "query_param", "ts")


register("rank_p95")(_on_log(timeseries.rank_p95, FULL))


# ---- sort, limit, paging --------------------------------------------------------------------
@register("safe_order_by")
def _safe_order_by(spark, sf):
    rows = reads.expressions(fx.query_log(spark, sf), FULL)
    fields = {field: F.col(name) for field, name in reads.EXPRESSION_SORTS.items()}
    keys = paging.sort_keys(fields, "executions", "avgDuration; --", "upwards", ["fingerprint"])
    path = new_table_path(spark, "sorted")
    paging.write_sorted(rows, keys, path)
    every = paging.sorted_page(spark.read.parquet(path), 0, 1 << 62)
    return every.select("position", "fingerprint", "executions")


@register("paginate")
def _paginate(spark, sf):
    request = PageRequest(page=3, size=25, sort_by="avgDuration", order="asc")
    page = reads.query_expressions(fx.query_log(spark, sf), FULL, request)
    return page.positioned().select("position", "fingerprint", "avg_duration")


@register("total_pages")
def _total_pages(spark, sf):
    return reads.query_expressions(fx.query_log(spark, sf), FULL, PageRequest(size=40)).counts


# ---- set operations -------------------------------------------------------------------------
@register("labelled_union")
def _labelled_union(spark, sf):
    code = F.col("status_code")
    counts = fx.query_log(spark, sf).agg(
        F.count_if(code < 300).alias("c0"), F.count_if(code.between(400, 499)).alias("c1"), F.count_if(code >= 500).alias("c2")
    )
    return timeseries.labelled_union(counts, ["ok", "client", "server"]).select("label", "count")


@register("time_spine")
def _time_spine(spark, sf):
    """Spine over the log's own window, from its first to its last event."""
    bounds = fx.query_log(spark, sf).agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    return buckets.time_spine(spark, TimeRange(bounds.a, bounds.b)).select("time")


# ---- keyed maintenance ----------------------------------------------------------------------
def _catalog_halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A catalog synced earlier from two thirds of the metrics, and a push of two thirds that overlaps it."""
    push = fx.metadata_push(spark, sf)
    rows = catalog_feeds.catalog_from_metadata(push)
    early = rows.where(F.col("seq") % 3 < 2).withColumns(
        {"synced_at": ntz("2023-12-01 00:00:00"), "help": F.concat(F.lit("old "), F.col("help"))}
    )
    target = upserts.upsert_catalog(fx.empty(spark, schemas.METRICS_CATALOG), early)
    return target, rows.where(F.col("seq") % 3 > 0)


@register("catalog_upsert")
def _catalog_upsert(spark, sf):
    return upserts.upsert_catalog(*_catalog_halves(spark, sf))


@register("summary_placeholder")
def _summary_placeholder(spark, sf):
    rows = upserts.add_placeholders(fx.usage_summary(spark, sf), fx.metrics_catalog(spark, sf), NOW)
    return rows.drop("updated_at")


@register("summary_merge")
def _summary_merge(spark, sf):
    """A summary of the middle window, merged into one that has every metric at the start."""
    target = upserts.add_placeholders(fx.usage_summary(spark, sf), fx.metrics_catalog(spark, sf), NOW)
    return upserts.merge_summary(target, fx.refreshed_summary(spark, sf, MIDDLE)).drop("updated_at")


@register("job_index_upsert")
def _job_index_upsert(spark, sf):
    """The stored index, refreshed with what the series show a day later."""
    pairs = catalog_feeds.job_index_from_series(fx.series(spark, sf)).withColumn("updated_at", ntz(NOW))
    return upserts.upsert_job_index(fx.job_index(spark, sf), pairs)


@register("rules_upsert")
def _rules_upsert(spark, sf):
    """Two pushes: the first half of the month, then the rest."""
    push = fx.rule_push(spark, sf)
    first = push.where(F.col("seen_at") < ntz("2024-01-15 00:00:00"))
    rest = push.where(F.col("seen_at") >= ntz("2024-01-15 00:00:00"))
    target = upserts.upsert_rules(fx.empty(spark, schemas.RULES_USAGE), first)
    return upserts.upsert_rules(target, rest).withColumn("labels", F.array_join("labels", ","))


@register("dashboards_upsert")
def _dashboards_upsert(spark, sf):
    push = fx.dashboard_push(spark, sf)
    first = push.where(F.col("seen_at") < ntz("2024-01-15 00:00:00"))
    rest = push.where(F.col("seen_at") >= ntz("2024-01-15 00:00:00"))
    target = upserts.upsert_dashboards(fx.empty(spark, schemas.DASHBOARD_USAGE), first)
    return upserts.upsert_dashboards(target, rest)


@register("retention_delete")
def _retention_delete(spark, sf):
    """What is left of a copy of the log after the retention job, and how much went."""
    path = new_table_path(spark, "retained_log")
    query_log.append_query_log(fx.query_log(spark, sf).drop("dt"), path)
    deleted = maintenance.apply_retention(spark, path, CUTOFF)
    left = query_log.read_query_log(spark, path)
    return left.select("query_id", "ts", F.lit(deleted).cast("long").alias("deleted"))


@register("retention_report")
def _retention_report(spark, sf):
    return maintenance.retention_report(fx.query_log(spark, sf), CUTOFF)


@register("is_unused_backfill")
def _is_unused_backfill(spark, sf):
    old = upserts.add_placeholders(fx.usage_summary(spark, sf), fx.metrics_catalog(spark, sf), NOW)
    return upserts.backfill_is_unused(old).select("name", "is_unused")


@register("summary_noop_check")
def _summary_noop_check(spark, sf):
    late = TimeRange.of("2024-03-01T00:00:00", "2024-04-01T00:00:00")
    return summary.summary_noop_check(fx.metrics_catalog(spark, sf), fx.refreshed_summary(spark, sf, late))


@register("inventory_sync")
def _inventory_sync(spark, sf):
    tables = inventory.Tables(spark, new_table_path(spark, "inventory"))
    inventory.inventory_sync(
        tables,
        fx.rules_usage(spark, sf),
        fx.dashboard_usage(spark, sf),
        fx.query_log(spark, sf),
        dt.datetime(2024, 1, 31),
        metadata=fx.metadata_push(spark, sf).select("name", "type", "help", "unit"),
        series=fx.series(spark, sf),
    )
    jobs_of = tables.read("metrics_job_index").groupBy("name").agg(F.count(F.lit(1)).alias("jobs"))
    return (
        tables.read("metrics_usage_summary")
        .join(tables.read("metrics_catalog").select("name", "type"), "name", "left")
        .join(jobs_of, "name", "left")
        .select("name", "type", *flt.COUNT_COLUMNS, "is_unused", F.coalesce("jobs", F.lit(0).cast("long")).alias("jobs"))
    )


# ---- streaming ------------------------------------------------------------------------------
def _stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # As a pattern the path may be one file or a folder of files.
    return spark.readStream.schema(fx.table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def _ingest(spark: SparkSession, sf: str) -> dict[str, str]:
    """Runs the ingest stream over the pushed bodies to its end; the folders it wrote."""
    at = {n: new_table_path(spark, f"stream_{n}") for n in ("push", "log", "ckpt", "rejects", "words", "metrics", "closed")}
    _push_bodies(spark, sf).write.text(at["push"])
    jobs.stream_query_log(spark, at["push"], at["log"], at["ckpt"], at["rejects"], at["words"], metrics=at["metrics"]).awaitTermination()
    return at


def _ingested(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    at = _ingest(spark, sf)
    return query_log.read_query_log(spark, at["log"]), spark.read.schema(jobs.REJECTS).parquet(at["rejects"])


@register("stream_query_ingest")
def _stream_query_ingest(spark, sf):
    return _ingested(spark, sf)[0].select(*_PUSHED, "fingerprint")


@register("stream_metric_log")
def _stream_metric_log(spark, sf):
    """The metric log that the stream writes beside the log; keys and times of receipt are its own."""
    return spark.read.parquet(_ingest(spark, sf)["metrics"]).select("metric", "is_first", *[c for c in enrich.METRIC_LOG if c not in ("query_id", "ts")])


@register("stream_closed_days")
def _stream_closed_days(spark, sf):
    """The streamed log once its days are closed, read through both tables."""
    at = _ingest(spark, sf)
    log_days.close_finished(spark, at["log"], f"{at['closed']}/log", dt.date.max)
    return log_days.read_streamed(spark, at["log"], f"{at['closed']}/log").select(*_PUSHED, "fingerprint")


@register("stream_query_rejects")
def _stream_query_rejects(spark, sf):
    """Refused records by reason, and how many records came in."""
    log, rejects = _ingested(spark, sf)
    reasons = rejects.groupBy("error").agg(F.count("*").alias("records"))
    return reasons.unionByName(log.agg(F.lit("none").alias("error"), F.count("*").alias("records")))


@register("stream_drop_unused")
def _stream_drop_unused(spark, sf):
    """The nested drop filter as a stream, against a stored summary."""
    root, source, target, checkpoint = (new_table_path(spark, f"drop_{n}") for n in ("tables", "exports", "kept", "ckpt"))
    inventory.Tables(spark, root).write("metrics_usage_summary", fx.usage_summary(spark, sf))
    exports = fx.otlp_exports(spark, sf)
    exports.write.parquet(source)
    stream = spark.readStream.schema(exports.schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(source)
    jobs.stream_drop_unused(stream, root, target, checkpoint, ALLOW, DENY).awaitTermination()
    return otlp.flatten_otlp(spark.read.schema(exports.schema).parquet(target)).select("export_id", "job", "metric_name", "points")


@register("stream_bucket_rollup")
def _stream_bucket_rollup(spark, sf):
    """Hourly counts of the event stream, each appended once the watermark has passed its hour. A closing row, long after all
    others, lets the watermark pass every hour of the events; its own hour stays open."""
    source, target, checkpoint = (new_table_path(spark, f"rollup_{n}") for n in ("events", "hours", "ckpt"))
    ev = fx.table(spark, sf, "events").select("ts", "value", "event_type", "event_id")
    closing = ev.agg(F.max("ts").alias("ts")).select(
        (F.col("ts") + F.make_dt_interval(F.lit(30))).alias("ts"), F.lit(0.0).alias("value"), F.lit("closing").alias("event_type"), F.lit(-1).cast("long").alias("event_id")
    )
    ev.unionByName(closing).write.parquet(source)
    ev = spark.readStream.schema(ev.schema).parquet(source)
    bad = F.col("event_type") == "error"
    log = ev.select(
        "ts",
        F.floor("value").alias("duration_ms"),
        F.when(~bad, F.lit(200)).when(F.col("event_id") % 2 == 0, F.lit(500)).otherwise(F.lit(422)).alias("status_code"),
    )
    rollup = jobs.stream_rollup(log, dt.timedelta(hours=1))
    writer = rollup.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start(target).awaitTermination()
    rows = spark.read.schema(rollup.schema).parquet(target)
    return rows.withColumn("time", F.col("time").cast("timestamp_ntz"))


register("otlp_unused_names")(_unused)


@register("otlp_drop_unused")
def _otlp_drop_unused(spark, sf):
    kept = otlp.drop_unused(fx.otlp_metrics(spark, sf), fx.unused_names(spark, sf), ALLOW, DENY)
    return kept.select("export_id", "line", "job", "metric_name", "points")


@register("otlp_drop_unused_nested")
def _otlp_drop_unused_nested(spark, sf):
    trees = otlp.drop_unused_nested(fx.otlp_exports(spark, sf), fx.unused_names(spark, sf), ALLOW, DENY)
    return otlp.flatten_otlp(trees).select("export_id", "job", "metric_name", "points")


@register("otlp_drop_unused_nested_join")
def _otlp_drop_unused_nested_join(spark, sf):
    """The same over the summary's lookup instead of the stored names."""
    trees = otlp.drop_unused_nested(fx.otlp_exports(spark, sf), _unused(spark, sf), ALLOW, DENY)
    return otlp.flatten_otlp(trees).select("export_id", "job", "metric_name", "points")


@register("otlp_drop_by_name_prefix")
def _otlp_drop_by_name_prefix(spark, sf):
    kept = otlp.drop_named(fx.otlp_metrics(spark, sf), DROP_NAMES, DROP_PREFIXES)
    return kept.select("export_id", "line", "metric_name")


@register("job_scope_rule")
def _job_scope_rule(spark, sf):
    active = scalars.drop_active(F.col("job"), ALLOW, DENY)
    return fx.otlp_metrics(spark, sf).groupBy("job", active.alias("active")).agg(F.count(F.lit(1)).alias("metrics"))


@register("otlp_dry_run")
def _otlp_dry_run(spark, sf):
    return otlp.dry_run(fx.otlp_metrics(spark, sf), fx.unused_names(spark, sf), ALLOW, DENY)


@register("catalog_seen_dedup")
def _catalog_seen_dedup(spark, sf):
    items = fx.events(spark, sf).select(fx.metric_name(F.col("user_id")).alias("name"), "ts")
    return otlp.seen_dedup(items, ttl=dt.timedelta(days=1))


@register("stream_seen_writes")
def _stream_seen_writes(spark, sf):
    target, checkpoint = new_table_path(spark, "seen_writes"), new_table_path(spark, "seen_writes_ckpt")
    items = _stream_of(spark, sf, "events").select(fx.metric_name(F.col("user_id")).alias("name"), "ts")
    found = jobs.stream_seen_writes(items, ttl=dt.timedelta(days=1))
    found.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return spark.read.schema(found.schema).parquet(target)


@register("stream_catalog_sync")
def _stream_catalog_sync(spark, sf):
    root, checkpoint = new_table_path(spark, "otlp_catalog"), new_table_path(spark, "otlp_catalog_ckpt")
    lines = _stream_of(spark, sf, "lineitem")
    metrics = fx.flat_metrics(fx.otlp_rows(lines)).drop("export_id", "line")
    jobs.stream_catalog_sync(metrics, root, checkpoint).awaitTermination()
    tables = inventory.Tables(spark, root)
    flags = tables.read("metrics_usage_summary").select("name", "is_unused")
    return tables.read("metrics_catalog").join(flags, "name", "left").select("name", "type", "help", "unit", "is_unused")


@register("fail_open_lookup")
def _fail_open_lookup(spark, sf):
    """Metrics the summary does not know stay, whatever their traffic."""
    known = fx.usage_summary(spark, sf).where(~F.col("name").contains("m_1"))
    names = otlp.otlp_unused(fx.otlp_metrics(spark, sf), known)
    kept = otlp.drop_unused(fx.otlp_metrics(spark, sf), names)
    return kept.groupBy("metric_name").agg(F.count(F.lit(1)).alias("metrics"))
