"""Scalar column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_HISTOGRAMS = ("histogram", "exponential_histogram")


def status_class(status: Column) -> Column:
    """``2xx`` / ``4xx`` / ``5xx``; codes of any other hundred have no class."""
    return (
        F.when(status.between(200, 299), F.lit("2xx"))
        .when(status.between(400, 499), F.lit("4xx"))
        .when(status.between(500, 599), F.lit("5xx"))
    )


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a UTC wall-clock timestamp."""
    return F.unix_timestamp(ts)


def from_epoch_seconds(seconds: Column) -> Column:
    """UTC wall-clock timestamp of whole or fractional seconds since 1970."""
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        zero, zero, zero, seconds.cast("decimal(18,6)")
    )


def range_seconds(start: Column, end: Column) -> Column:
    return epoch_seconds(end) - epoch_seconds(start)


def parse_time_param(text: Column, now: Column) -> Column:
    """RFC 3339, else epoch seconds (whole or fractional), else ``now``; always UTC."""
    rfc3339 = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"),
        F.to_utc_timestamp(text.try_cast("timestamp"), F.current_timezone()).cast("timestamp_ntz"),
    )
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    micros = F.floor(number * F.lit(1e6)).cast("long")
    epoch = from_epoch_seconds(micros / F.lit(1_000_000))
    return F.coalesce(rfc3339, epoch, now)


def extract_headers(request: Column, response: Column, names: Sequence[str]) -> Column:
    """Named headers, the request's before the response's; empty and absent ones are left out.

    Header names compare without case; the result carries the asked-for spelling.
    """

    def value(headers: Column, name: str) -> Column:
        hit = F.filter(
            F.map_entries(headers), lambda e: (F.lower(e["key"]) == name.lower()) & (e["value"] != "")
        )
        return F.get(hit, F.lit(0))["value"]

    entries = F.array(
        *[
            F.struct(F.lit(n).alias("key"), F.coalesce(value(request, n), value(response, n)).alias("value"))
            for n in dict.fromkeys(names)
        ]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def prom_metric_name(name: Column, data_type: Column, is_monotonic: Column) -> Column:
    """Name under which an OTLP metric is queried: a monotonic sum ends in ``_total``."""
    counter = (data_type == "sum") & F.coalesce(is_monotonic, F.lit(False))
    return F.when(counter & (name != "") & ~name.endswith("_total"), F.concat(name, F.lit("_total"))).otherwise(name)


def otlp_prom_type(data_type: Column, is_monotonic: Column) -> Column:
    return (
        F.when((data_type == "sum") & F.coalesce(is_monotonic, F.lit(False)), F.lit("counter"))
        .when(data_type.isin("gauge", "sum"), F.lit("gauge"))
        .when(data_type.isin(*_HISTOGRAMS), F.lit("histogram"))
        .when(data_type == "summary", F.lit("summary"))
        .otherwise(F.lit("unknown"))
    )


def resolve_job(attributes: Column) -> Column:
    """``job`` attribute, else ``service.name``, else empty."""
    return F.coalesce(
        F.nullif(attributes["job"], F.lit("")), F.nullif(attributes["service.name"], F.lit("")), F.lit("")
    )


def drop_active(job: Column, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Column:
    """Whether unused metrics of ``job`` may be dropped."""
    allowed = job.isin(*allow) if allow else F.lit(True)
    denied = job.isin(*deny) if deny else F.lit(False)
    return allowed & ~denied
