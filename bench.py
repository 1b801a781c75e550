"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Reads run on the stored, enriched log, as they do after ingestion; ingestion is timed on its
own. The listings run on catalogs of 2 400, 24 000 and 240 000 rows with one metric in ten unused,
and on a dense one with 144 000 unused of 240 000; a job exposes one metric in a hundred.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger import fixtures as fx
from metricledger import registry
from metricledger.functions.expr_tools import ntz
from metricledger.operators import otlp
from metricledger.params import PageRequest
from metricledger.plans import metadata
from metricledger.session import local_session, new_table_path

HEADLINE = [
    "query_status_distribution",
    "query_latency_trends",
    "query_throughput",
    "query_errors",
    "query_time_range_distribution",
    "query_expressions",
    "query_rate",
    "queries_by_metric",
    "query_count_by_metric",
    "usage_summary",
    "rules_latest",
    "dashboards_latest",
    "otlp_unused_names",
    "otlp_drop_unused",
    "otlp_point_counts",
    "catalog_seen_dedup",
]
# (rows, unused out of ten, page sizes)
LISTINGS = (
    (2_400, 1, (10, 10_000)),
    (24_000, 1, (10, 10_000)),
    (240_000, 1, (10, 10_000)),
    (240_000, 6, (10, 1_000, 10_000)),
)
# OTLP filter: exported metrics, and how many of ten are unused.
OTLP_SHAPES = [(size, unused) for size in (100, 1_000, 10_000, 100_000, 1_048_576) for unused in (0, 5, 9)]
REPEATS = 3


def consume(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run: Callable[[], None]) -> float:
    """Median over the repeats, after one run that warms the JVM."""
    run()
    seconds = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 4)


def listing_tables(spark: SparkSession, size: int, unused_of_ten: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    name = F.format_string("metric_%07d", F.col("id"))
    at, zero, n = ntz("2024-01-30 00:00:00"), F.lit(0).cast("long"), F.col("id")
    ids = spark.range(size)
    unused = n % 10 < unused_of_ten
    frames = {
        "catalog": ids.select(name.alias("name"), F.lit("gauge").alias("type"), F.lit("help").alias("help"), F.lit("").alias("unit")),
        "summary": ids.select(
            name.alias("name"),
            zero.alias("alert_count"),
            zero.alias("record_count"),
            zero.alias("dashboard_count"),
            F.when(unused, zero).otherwise(n).alias("query_count"),
            F.when(~unused, at).alias("last_queried_at"),
            at.alias("updated_at"),
            unused.alias("is_unused"),
        ),
        "jobs": ids.select(name.alias("name"), F.concat(F.lit("job"), n % 100).alias("job"), at.alias("updated_at")),
    }
    out = []
    for key, frame in frames.items():
        path = new_table_path(spark, f"bench_{key}")
        frame.write.parquet(path)
        out.append(spark.read.parquet(path))
    return tuple(out)


def otlp_tables(spark: SparkSession, size: int, unused_of_ten: int) -> tuple[DataFrame, DataFrame]:
    """Flat metrics of five points each, and the stored names of the unused ones."""
    name, n = F.format_string("metric_%07d", F.col("id")), F.col("id")
    metrics = spark.range(size).select(name.alias("metric_name"), F.concat(F.lit("job"), n % 100).alias("job"), F.lit(5).cast("long").alias("points"))
    path = new_table_path(spark, "bench_names")
    spark.range(size).where(n % 10 < unused_of_ten).select(name.alias("metric_name")).write.parquet(path)
    return metrics, spark.read.schema("metric_name string").parquet(path)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench", shared=tempfile.mkdtemp(prefix="bench-"))
    times: dict[str, float] = {}

    start = time.perf_counter()
    fx.query_log(spark, sf)
    times["ingest_cold"] = round(time.perf_counter() - start, 4)

    def ingest() -> None:
        fx.ingest_log(spark, sf, new_table_path(spark, "bench_log"))

    times["ingest"] = timed(ingest)
    queries = registry.queries()
    for name in HEADLINE:
        times[name] = timed(lambda: consume(queries[name](spark, sf)))
    for size, unused_of_ten, pages in LISTINGS:
        catalog, summary, jobs = listing_tables(spark, size, unused_of_ten)
        shape = f"{size}_{unused_of_ten}0pct"
        for page in pages:
            request = PageRequest(size=page, order="asc")

            def unused() -> None:
                metadata.series_metadata(catalog, summary, jobs, request, usage="unused").data.collect()

            def unused_job() -> None:
                metadata.series_metadata(catalog, summary, jobs, request, usage="unused", job="job10").data.collect()

            times[f"series_metadata_unused_{shape}_page{page}"] = timed(unused)
            times[f"series_metadata_unused_job_{shape}_page{page}"] = timed(unused_job)

    for size, unused_of_ten in OTLP_SHAPES:
        metrics, names = otlp_tables(spark, size, unused_of_ten)
        times[f"otlp_filter_{size}_{unused_of_ten}0pct"] = timed(lambda: consume(otlp.drop_unused(metrics, names)))

    result = {
        "metric": "total_seconds_of_headline_queries",
        "value": round(sum(v for k, v in times.items() if k != "ingest_cold"), 4),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
