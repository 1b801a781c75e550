"""Plans and hot keys: what has to hold when the tables are large."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricledger import fixtures as fx
from metricledger import registry
from metricledger.operators import enrich
from metricledger.params import TimeRange
from metricledger.plans import reads, timeseries
from tests.conftest import BASE, plan_of

# Jobs that write or stream before they return; their plans only read the result.
JOBS = {"stream_query_rejects", "stream_drop_unused", "safe_order_by", "inventory_sync", "retention_delete", "stream_query_ingest", "stream_bucket_rollup", "stream_catalog_sync", "stream_metric_log", "stream_closed_days"}
LOG_READS = [
    "query_status_distribution",
    "query_latency_trends",
    "query_expressions",
    "query_count_by_metric",
    "query_time_range_distribution",
]


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - JOBS))
def test_no_python_and_no_nested_loops(spark, sf, name):
    plan = plan_of(registry.queries()[name](spark, sf))
    for forbidden in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "NestedLoop"):
        assert forbidden not in plan


@pytest.mark.parametrize("name", LOG_READS)
def test_window_reaches_the_scan(spark, sf, name):
    plan = plan_of(registry.queries()[name](spark, sf))
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "query_log" in line)
    assert "dt#" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(ts" in scan
    assert "http_headers" not in scan.split("ReadSchema")[1]
    assert "label_matchers" not in scan.split("ReadSchema")[1]


@pytest.fixture(scope="module")
def hot_log(spark, sf):
    """The test log, where one expression and one bucket also hold about a third of all rows."""
    log = fx.query_log(spark, sf)
    share = log.count() // 2
    top = log.where("query_param <> ''").first()
    hot = log.where(F.col("query_id") == top.query_id).crossJoin(spark.range(share)).drop("id")
    return log.unionByName(hot.withColumn("query_id", F.monotonically_increasing_id() + 10_000_000)), top, share


def test_hot_expression_and_bucket(hot_log):
    log, top, share = hot_log
    rows = {r.fingerprint: r for r in reads.expressions(log, fx.FULL).collect()}
    assert rows[top.fingerprint].executions >= share
    assert sum(r.executions for r in rows.values()) == log.where("ts <= '2024-01-31'").count()
    assert sum(r.value for r in timeseries.throughput(log, fx.FULL).collect()) == 3 * share
    at = TimeRange(top.ts.replace(second=0, microsecond=0), top.ts.replace(second=0, microsecond=0) + dt.timedelta(minutes=1))
    assert timeseries.latency_trends(log, at).agg(F.max("p95")).first()[0] == top.duration_ms


def test_percentile_shuffles_counts_not_rows(hot_log):
    plan = plan_of(timeseries.latency_trends(hot_log[0], fx.FULL))
    before_window = plan.split("Window [")[-1]
    assert before_window.count("HashAggregate(keys=[idx") == 2  # partial and final counts, below the sort


def test_skewed_text_is_split_when_the_dictionary_is_large(spark, tmp_path):
    """Without a broadcast, adaptive execution splits the hot text's partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        # With 8 partitions a third of the rows is little more than the default factor of 5.
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        log = spark.range(0, 300_000, 1, 16).select(
            F.col("id").alias("query_id"),
            F.when(F.col("id") % 3 == 0, F.lit("up")).otherwise(F.concat(F.lit("m"), F.col("id") % 500)).alias("query_param"),
        )
        texts = log.select("query_param").distinct()
        dictionary = texts.select(
            "query_param",
            F.md5("query_param").alias("fingerprint"),
            F.lit(None).cast("array<map<string,string>>").alias("label_matchers"),
            F.lit(None).cast("array<string>").alias("metric_names"),
        )
        dictionary.write.parquet(str(tmp_path / "texts"))
        joined = enrich.enrich(log, spark.read.parquet(str(tmp_path / "texts")))
        assert joined.groupBy().agg(F.count("fingerprint")).first()[0] == 300_000
        done = joined.select("query_id", "fingerprint")
        done.collect()
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_invalid_texts_share_one_identity(spark):
    log = spark.createDataFrame([(i, t, BASE) for i, t in enumerate(["up{", "rate(", None, "up"])], "query_id int, query_param string, ts timestamp_ntz")
    rows = {r.query_id: r for r in enrich.enrich(log, enrich.expression_dictionary(log)).collect()}
    assert [rows[i].fingerprint for i in (0, 1, 2)] == ["", "", ""]
    assert rows[3].fingerprint != ""


@pytest.mark.parametrize("name", ["query_rate", "queries_by_metric", "metric_query_performance", "query_latency_trends_metric", "metric_match_any"])
def test_metric_reaches_the_scan(spark, sf, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", 2_000)
    try:
        plan = plan_of(registry.queries()[name](spark, sf))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "metric_log" in line)
    assert "EqualTo(metric," in scan.split("PushedFilters")[1]
