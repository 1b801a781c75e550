"""Validation and defaults of pushed query records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_STEP = 15.0
QUERY_TYPES = ("range", "instant")
# The HTTP status codes that have a standard text.
HTTP_STATUS = (
    *range(100, 104),
    *range(200, 209),
    226,
    *range(300, 306),
    307,
    308,
    *range(400, 419),
    *range(421, 427),
    428,
    429,
    431,
    451,
    *range(500, 509),
    510,
    511,
)


def problems(now: Column) -> Column:
    """First problem of a record, or NULL; checks run in a fixed order and stop at the first."""
    is_range = F.col("type") == "range"
    # A zero time counts as missing, like NULL.
    checks = [
        (F.coalesce(F.col("query_param"), F.lit("")) == "", "missing query parameter"),
        (F.col("body_size") < 0, "invalid body size"),
        (F.col("duration_ms") < 0, "invalid duration"),
        (~F.coalesce(F.col("type").isin(*QUERY_TYPES), F.lit(False)), "invalid query type"),
        (~F.coalesce(F.col("status_code").isin(*HTTP_STATUS), F.lit(False)), "invalid status code"),
        (F.col("step") < 0, "invalid step"),
        (is_range & F.col("start_ts").isNull(), "missing start parameter"),
        (is_range & F.col("end_ts").isNull(), "missing end parameter"),
        (is_range & (F.col("end_ts") < F.col("start_ts")), "invalid range: end before start"),
    ]
    out = None
    for bad, message in checks:
        out = F.when(bad, F.lit(message)) if out is None else out.when(bad, F.lit(message))
    return out


def check_queries(df: DataFrame, now: Column) -> DataFrame:
    """Records with defaults filled in and an ``error`` column.

    Range records without a positive step get the default step; instant records without a
    range start and end at their evaluation time.
    """
    at = F.coalesce(F.col("time_param"), now)
    instant = F.col("type") == "instant"
    return df.withColumn("error", problems(now)).withColumns(
        {
            "time_param": at,
            "step": F.when((F.col("type") == "range") & (F.coalesce(F.col("step"), F.lit(0.0)) <= 0), F.lit(DEFAULT_STEP))
            .otherwise(F.coalesce(F.col("step"), F.lit(0.0))),
            "start_ts": F.when(instant, F.coalesce(F.col("start_ts"), at)).otherwise(F.col("start_ts")),
            "end_ts": F.when(instant, F.coalesce(F.col("end_ts"), at)).otherwise(F.col("end_ts")),
        }
    )


def validate_queries(
    df: DataFrame, now: Column, mode: str = "split", batch: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected).

    ``split`` rejects single records. ``fail_batch`` rejects every record of a push that holds
    a bad one; pushes are told apart by the ``batch`` column, or all records are one push.
    """
    checked = check_queries(df, now)
    good, bad = checked.where(F.col("error").isNull()), checked.where(F.col("error").isNotNull())
    if mode == "split":
        return good.drop("error"), bad
    if mode != "fail_batch":
        raise ValueError(f"unknown mode {mode!r}")
    if batch is None:
        none_failed = bad.agg(F.count(F.lit(1)) == 0).scalar()
        return good.where(none_failed).drop("error"), bad
    failed = bad.select(batch).distinct()
    return good.join(failed, batch, "left_anti").drop("error"), bad
