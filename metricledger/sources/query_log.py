"""The query log: append, read, and bulk push input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricledger import schemas
from metricledger.functions.scalars import parse_time_param

_KNOWN_FIELDS = [f.name for f in schemas.QUERY_PUSH.fields]
_ZERO_TIME = "0001-01-01T00:00:00Z"
#: Distinct expressions that a file is expected to hold.
FILE_EXPRESSIONS = 100_000


def identity_bloom(expressions: int = FILE_EXPRESSIONS) -> dict[str, str]:
    """Writer options: a Bloom filter on the fingerprint, sized for so many of them in a file."""
    return {"parquet.bloom.filter.enabled#fingerprint": "true", "parquet.bloom.filter.expected.ndv#fingerprint": str(expressions)}


def append_query_log(log: DataFrame, path: str, spread: bool = True, expressions: int = FILE_EXPRESSIONS) -> None:
    """Append records, one folder per day.

    ``spread`` redistributes by day first, so that a day is written in few files; the hint is
    a rebalance, which adaptive execution splits for a day that holds much of the data. Skip it
    for batches that already lie within one day. Rows are sorted by time inside each file, which
    keeps the row-group bounds narrow for time filters; a Bloom filter on the fingerprint lets
    lookups of one expression skip row groups.
    """
    daily = log.withColumn("dt", F.to_date("ts"))
    if spread:
        daily = daily.hint("rebalance", F.col("dt"))
    sorted_rows = daily.sortWithinPartitions("dt", "ts")
    sorted_rows.write.mode("append").options(**identity_bloom(expressions)).partitionBy("dt").parquet(path)


def append_metric_log(rows: DataFrame, path: str) -> None:
    """Append rows of :func:`enrich.metric_log`, one folder per day, sorted by metric inside each file: the
    bounds of row groups then tell which hold a metric. The rebalance splits a day, or a metric, that holds much."""
    daily = rows.withColumn("dt", F.to_date("ts")).hint("rebalance", F.col("dt"), F.col("metric"))
    daily.sortWithinPartitions("dt", "metric", "ts").write.mode("append").partitionBy("dt").parquet(path)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


#: RFC 3339, the only form of a pushed time.
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def _parsed_time(text: Column) -> Column:
    return parse_time_param(text, F.lit(None).cast("timestamp_ntz"))


def _push_time(text: Column) -> Column:
    return F.when(text != _ZERO_TIME, _parsed_time(text))


def _accepted(kind: str, value: Column) -> Column:
    """Whether a JSON value may stand in a field of that kind; missing and null ones always may."""
    found, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    if kind == "string":
        fits = found == "STRING"
    elif kind == "long":
        fits = found == "BIGINT"
    elif kind == "int":
        fits = (found == "BIGINT") & F.try_variant_get(value, "$", "int").isNotNull()
    elif kind == "double":
        fits = found.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    elif kind == "time":
        fits = (found == "STRING") & text.rlike(_RFC3339) & ((text == _ZERO_TIME) | _parsed_time(text).isNotNull())
    else:
        values = F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
        fits = found.startswith("OBJECT") & F.forall(values, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin("STRING", "VOID"))
    return F.coalesce(found, F.lit("VOID")).isin("VOID") | F.coalesce(fits, F.lit(False))


def _kind(field: T.StructField) -> str:
    return "time" if field.name in ("time_param", "start", "end") else "map" if isinstance(field.dataType, T.MapType) else field.dataType.simpleString().replace("bigint", "long")


def parse_query_push(lines: DataFrame, strict: bool = True, received: Column | None = None) -> DataFrame:
    """Push bodies (column ``value``) as records with an ``error`` column; other columns are carried along.

    A body is one JSON object or an array of them. Field names compare without case; of a field given twice the last one
    counts. ``strict`` marks records that carry unknown fields; what cannot be parsed, and fields of a wrong type, are marked
    either way. Times are RFC 3339. Wire durations are nanoseconds. ``record`` keeps the text.
    """
    carried = [c for c in lines.columns if c != "value"]
    body = F.trim("value")
    items = F.when(body.startswith("["), F.from_json(body, "array<string>")).otherwise(F.array(body))
    records = lines.select(*carried, F.posexplode_outer(items).alias("position", "record"))
    entries = F.map_entries(F.from_json("record", "map<string,variant>"))
    rows = records.withColumn("_fields", F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("name"), e["key"].alias("spelled"), e["value"].alias("value"))))

    def given(name: str) -> Column:
        return F.try_element_at(F.filter("_fields", lambda e: e["name"] == name), F.lit(-1))["value"]

    rows = rows.withColumns({f"_{name}": given(name) for name in _KNOWN_FIELDS})
    unknown = F.get(F.filter("_fields", lambda e: ~e["name"].isin(*_KNOWN_FIELDS)), F.lit(0))["spelled"]
    error = F.when(F.col("_fields").isNull() | (F.size("_fields") == 0), F.lit("invalid record"))
    if strict:
        error = error.when(unknown.isNotNull(), F.concat(F.lit("unknown field "), unknown))
    for field in schemas.QUERY_PUSH.fields:
        error = error.when(~_accepted(_kind(field), F.col(f"_{field.name}")), F.lit(f"invalid field {field.name}"))
    now = received if received is not None else utc_now()

    def value(name: str, kind: str, default: object) -> Column:
        return F.coalesce(F.try_variant_get(f"_{name}", "$", kind), F.lit(default).cast(kind))

    def moment(name: str) -> Column:
        return _push_time(F.try_variant_get(f"_{name}", "$", "string"))

    return rows.select(
        *carried,
        "position",
        "record",
        now.alias("ts"),
        value("query_param", "string", "").alias("query_param"),
        moment("time_param").alias("time_param"),
        F.floor(value("duration", "bigint", 0) / 1_000_000).alias("duration_ms"),
        value("status_code", "int", 0).alias("status_code"),
        value("body_size", "int", 0).alias("body_size"),
        value("type", "string", "").alias("type"),
        value("step", "double", 0.0).alias("step"),
        moment("start").alias("start_ts"),
        moment("end").alias("end_ts"),
        value("total_queryable_samples", "bigint", 0).alias("total_queryable_samples"),
        value("peak_samples", "bigint", 0).alias("peak_samples"),
        F.try_variant_get("_http_headers", "$", "map<string,string>").alias("http_headers"),
        error.alias("error"),
    )


def utc_now() -> Column:
    """The current time as UTC wall clock, whatever the session's zone. A streaming plan fixes it for each batch."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz")


def read_query_push(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Push bodies from text files, one body per line."""
    return parse_query_push(spark.read.text(path), strict)


def parse_response_stats(df: DataFrame, body_col: str) -> DataFrame:
    """Sample counts from the backend's JSON reply; zero unless it succeeded."""
    reply = F.from_json(F.col(body_col), schemas.BACKEND_REPLY)
    rows = df.withColumn("_reply", reply)
    ok = F.coalesce(F.col("_reply.status") == "success", F.lit(False))

    def stat(name: str) -> Column:
        value = F.col(f"_reply.data.stats.samples.{name}")
        return F.when(ok, F.coalesce(value, F.lit(0))).otherwise(F.lit(0))

    return rows.withColumns(
        {"total_queryable_samples": stat("totalQueryableSamples"), "peak_samples": stat("peakSamples")}
    ).drop("_reply")
