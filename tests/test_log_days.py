import datetime as dt

import pytest
from pyspark.sql import functions as F

from metricledger.sources import folders
from metricledger.sources.query_log import append_query_log
from metricledger.streaming import log_days
from tests.conftest import BASE

DAY = BASE.date()


@pytest.fixture
def tables(spark, make_log, tmp_path):
    """An open table with two days of two batches each, and the folder for closed days."""
    streamed, closed = str(tmp_path / "streamed"), str(tmp_path / "closed")

    def put(*rows):
        """(query id, hour, batch)"""
        log = make_log(*[{"query_id": q, "ts": BASE + dt.timedelta(hours=h)} for q, h, _ in rows])
        batch = F.element_at(F.create_map(*[F.lit(v).cast("long") for q, _, b in rows for v in (q, b)]), F.col("query_id"))
        log.withColumn("batch_id", batch).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch_id").parquet(streamed)

    put((1, 1, 1), (2, 2, 1), (3, 3, 2), (4, 25, 3), (5, 26, 4))
    return streamed, closed, put


def ids(df):
    return sorted(r.query_id for r in df.select("query_id").collect())


def test_finished_days_move_and_count_once(spark, tables):
    streamed, closed, _ = tables
    assert log_days.close_finished(spark, streamed, closed, DAY + dt.timedelta(days=1)) == [DAY]
    assert ids(spark.read.parquet(streamed)) == [4, 5] and ids(spark.read.parquet(closed)) == [1, 2, 3]
    assert ids(log_days.read_streamed(spark, streamed, closed)) == [1, 2, 3, 4, 5]
    assert log_days.close_finished(spark, streamed, closed, DAY + dt.timedelta(days=1)) == []


def test_closing_that_broke_off(spark, tables):
    """The closed day is written, the streamed one still there: rows count once, and closing again loses none."""
    streamed, closed, put = tables
    log_days.close_day(spark, streamed, closed, DAY)
    put((1, 1, 1), (2, 2, 1), (3, 3, 2))
    assert ids(log_days.read_streamed(spark, streamed, closed)) == [1, 2, 3, 4, 5]
    log_days.close_day(spark, streamed, closed, DAY)
    assert ids(spark.read.parquet(closed)) == [1, 2, 3] and not folders.exists(spark, f"{streamed}/dt={DAY}")


def test_batch_repeated_after_its_day_was_closed(spark, tables):
    streamed, closed, put = tables
    log_days.close_day(spark, streamed, closed, DAY)
    put((3, 3, 2))
    assert ids(log_days.read_streamed(spark, streamed, closed)) == [1, 2, 3, 4, 5]
    log_days.close_day(spark, streamed, closed, DAY)
    assert ids(log_days.read_streamed(spark, streamed, closed)) == [1, 2, 3, 4, 5]


def test_appended_log_is_left_alone(spark, tables, make_log, tmp_path):
    streamed, closed, _ = tables
    log = str(tmp_path / "log")
    append_query_log(make_log({"query_id": 9, "ts": BASE}), log)
    log_days.close_finished(spark, streamed, closed, dt.date.max)
    assert ids(spark.read.parquet(log)) == [9]
    assert ids(log_days.read_streamed(spark, streamed, closed)) == [1, 2, 3, 4, 5]


def test_old_days_go(spark, tables):
    streamed, closed, _ = tables
    log_days.close_finished(spark, streamed, closed, DAY + dt.timedelta(days=2), keep=dt.timedelta(hours=22))
    assert ids(log_days.read_streamed(spark, streamed, closed)) == [5]
