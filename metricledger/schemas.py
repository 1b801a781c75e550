"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _N, _B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.TimestampNTZType(),
    T.BooleanType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LABELS = T.MapType(_S, _S)

QUERY_LOG = _struct(
    query_id=_L,  # stable key of a record
    ts=_N,
    query_param=_S,
    time_param=_N,
    duration_ms=_L,
    status_code=_I,
    body_size=_I,
    fingerprint=_S,
    label_matchers=T.ArrayType(LABELS),
    metric_names=T.ArrayType(_S),  # metric of every selector, in order; what the reads look at
    type=_S,
    step=_D,
    start_ts=_N,
    end_ts=_N,
    total_queryable_samples=_L,
    peak_samples=_L,
    http_headers=LABELS,
    dt=T.DateType(),
)

# A pushed record, under its JSON names; the duration is in nanoseconds on the wire.
QUERY_PUSH = _struct(
    query_param=_S,
    time_param=_S,
    duration=_L,
    status_code=_I,
    body_size=_I,
    type=_S,
    step=_D,
    start=_S,
    end=_S,
    total_queryable_samples=_L,
    peak_samples=_L,
    http_headers=LABELS,
)

RULES_USAGE = _struct(
    serie=_S,
    group_name=_S,
    name=_S,
    expression=_S,
    kind=_S,
    labels=T.ArrayType(_S),
    created_at=_N,
    first_seen_at=_N,
    last_seen_at=_N,
)

DASHBOARD_USAGE = _struct(
    id=_S, serie=_S, name=_S, url=_S, created_at=_N, first_seen_at=_N, last_seen_at=_N
)

METRICS_CATALOG = _struct(name=_S, type=_S, help=_S, unit=_S, first_seen_at=_N, last_synced_at=_N)

USAGE_SUMMARY = _struct(
    name=_S,
    alert_count=_L,
    record_count=_L,
    dashboard_count=_L,
    query_count=_L,
    last_queried_at=_N,
    updated_at=_N,
    is_unused=_B,
)

JOB_INDEX = _struct(name=_S, job=_S, updated_at=_N)

_RULE = _struct(prom_link=_S, group_name=_S, name=_S, expression=_S)
_DASHBOARD = _struct(id=_S, name=_S, url=_S)
USAGE_PUSH = T.MapType(
    _S,
    _struct(
        dashboards=T.ArrayType(_DASHBOARD),
        alertRules=T.ArrayType(_RULE),
        recordingRules=T.ArrayType(_RULE),
    ),
)

BACKEND_REPLY = _struct(
    status=_S,
    data=_struct(
        resultType=_S,
        stats=_struct(samples=_struct(totalQueryableSamples=_L, peakSamples=_L)),
    ),
)

OTLP_METRIC = _struct(
    name=_S,
    description=_S,
    unit=_S,
    data_type=_S,
    is_monotonic=_B,
    data_points=T.ArrayType(_struct(ts=_N, value=_D)),
)
OTLP_EXPORT = _struct(
    export_id=_L,
    resource_metrics=T.ArrayType(
        _struct(
            attributes=LABELS,
            scope_metrics=T.ArrayType(_struct(scope=_S, metrics=T.ArrayType(OTLP_METRIC))),
        )
    ),
)
