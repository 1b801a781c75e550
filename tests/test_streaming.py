import datetime as dt
import json
import os
import time

import pytest

from metricledger.operators import enrich, otlp
from metricledger.plans import reads
from metricledger.plans.inventory import Tables
from metricledger.streaming import jobs, log_days
from tests.conftest import BASE, plan_of

PUSH = {"query_param": 'up{a="1"}', "duration": 5_000_000, "status_code": 200, "type": "instant"}


def drop_file(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as out:
        out.write("\n".join(lines))


@pytest.fixture
def ingest(spark, tmp_path):
    """Runs the ingest stream to its end; gives log, rejects and the checkpoint."""
    source, target, ckpt, rejects, words = (str(tmp_path / n) for n in ("in", "log", "ckpt", "rejects", "words"))

    def run():
        jobs.stream_query_log(spark, source, target, ckpt, rejects, words).awaitTermination()
        return spark.read.parquet(target), spark.read.schema(jobs.REJECTS).parquet(rejects)

    run.source, run.ckpt, run.words = source, ckpt, words
    return run


def test_ingest_continues_and_does_not_repeat(spark, ingest):
    drop_file(ingest.source, "a.json", [json.dumps([PUSH, {**PUSH, "type": "bad"}])])
    ingest()
    drop_file(ingest.source, "b.json", [json.dumps({**PUSH, "query_param": 'up{a="2"}'}), json.dumps({**PUSH, "x": 1}), "no json"])
    for _ in range(2):
        log, rejects = ingest()
    rows = log.collect()
    assert len(rows) == 2 and len({r.query_id for r in rows}) == 2
    assert len({r.fingerprint for r in rows}) == 1
    assert sorted(r.label_matchers[0]["a"] for r in rows) == ["1", "2"]
    assert {r.batch_id for r in rows} == {0, 1}
    refused = sorted((r.batch_id, r.error) for r in rejects.collect())
    assert refused == [(0, "invalid query type"), (1, "invalid record"), (1, "unknown field x")]
    assert spark.read.parquet(ingest.words).count() == 2  # each text described once


def test_repeated_batch_on_another_day(spark, ingest):
    """The commit of a batch is lost and the stream goes on in a zone where it is another day."""
    drop_file(ingest.source, "a.json", [json.dumps([PUSH, {**PUSH, "step": "x"}])])
    before = {r.query_id: r.ts for r in ingest()[0].collect()}
    for f in os.listdir(os.path.join(ingest.ckpt, "commits")):
        os.remove(os.path.join(ingest.ckpt, "commits", f))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("Pacific/Kiritimati", "Pacific/Pago_Pago"):
            spark.conf.set("spark.sql.session.timeZone", other)
            log, rejects = ingest()
            assert {r.query_id: r.ts for r in log.collect()} == before and rejects.count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    assert all(abs((now - ts).total_seconds()) < 600 for ts in before.values())


def test_reads_run_on_the_streamed_log(spark, ingest, tmp_path):
    drop_file(ingest.source, "a.json", [json.dumps([PUSH] * 3), json.dumps({**PUSH, "query_param": "down"})])
    log, _ = ingest()
    assert reads.latest_by_fingerprint(log).count() == 2
    assert enrich.metric_refs(log).count() == 4
    day, streamed, closed = log.first().dt, str(tmp_path / "log"), str(tmp_path / "closed")
    assert [log_days.close_day(spark, streamed, closed, day) for _ in range(2)] == [True, False]
    assert spark.read.parquet(closed).count() == log_days.read_streamed(spark, streamed, closed).count() == 4


def log_stream(spark, folder, batches):
    """One file per batch, read in order, one per micro-batch."""
    for i, batch in enumerate(batches):
        df = spark.createDataFrame(batch, "ts timestamp_ntz, duration_ms long, status_code int")
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return spark.readStream.schema("ts timestamp_ntz, duration_ms long, status_code int").option(
        "maxFilesPerTrigger", 1
    ).parquet(folder)


def at(minutes):
    return BASE + dt.timedelta(minutes=minutes)


def test_rollup_emits_closed_buckets_and_drops_late_rows(spark, tmp_path):
    batches = [
        [(at(0), 1, 200), (at(4), 3, 500)],
        [(at(30), 5, 404)],
        [(at(32), 0, 200)],  # Spark judges lateness by the watermark of the batch before
        [(at(1), 100, 200), (at(31), 7, 200)],  # the first row is later than the watermark allows
        [(at(90), 0, 200)],
    ]
    stream = log_stream(spark, str(tmp_path / "in"), batches)
    rollup = jobs.stream_rollup(stream, dt.timedelta(minutes=5), dt.timedelta(minutes=5))
    target = str(tmp_path / "out")
    query = (
        rollup.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    rows = {(r.time - BASE).total_seconds() / 60: r for r in spark.read.parquet(target).collect()}
    assert sorted(rows) == [0, 30]
    assert (rows[0].total, rows[0].status_2xx, rows[0].status_5xx, rows[0].duration_sum) == (2, 1, 1, 4)
    assert (rows[30].total, rows[30].status_4xx, rows[30].duration_sum) == (3, 1, 12)


def test_catalog_sync_adds_names_once(spark, tmp_path):
    folder, root, ckpt = (str(tmp_path / n) for n in ("in", "tables", "ckpt"))
    schema = (
        "metric_name string, data_type string, is_monotonic boolean, description string, unit string, points long, "
        "job string, ts timestamp_ntz"
    )
    rows = [("calls", "gauge", False, "d", "u", 1, "j", at(0)), ("calls", "gauge", False, "d", "u", 1, "j", at(5))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    stream = lambda: spark.readStream.schema(schema).parquet(folder)
    jobs.stream_catalog_sync(stream(), root, ckpt).awaitTermination()
    more = [("h", "histogram", False, "d", "u", 1, "j", at(6)), ("calls", "gauge", False, "d", "u", 1, "j", at(7))]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(folder)
    jobs.stream_catalog_sync(stream(), root, ckpt).awaitTermination()
    tables = Tables(spark, root)
    catalog = {r.name: r.type for r in tables.read("metrics_catalog").collect()}
    assert catalog == {"calls": "gauge", "h": "histogram", "h_bucket": "histogram", "h_sum": "histogram", "h_count": "histogram"}
    assert not any(r.is_unused for r in tables.read("metrics_usage_summary").collect())
    synced = {r.name: r.last_synced_at for r in tables.read("metrics_catalog").collect()}
    assert synced["calls"] == at(5)  # seen again two minutes later, within the hour
    late = [("calls", "gauge", False, "new", "u", 1, "j", at(90))]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(folder)
    jobs.stream_catalog_sync(stream(), root, ckpt).awaitTermination()
    row = tables.read("metrics_catalog").where("name = 'calls'").first()
    assert (row.help, row.first_seen_at, row.last_synced_at) == ("new", at(5), at(90))


def test_stream_dedup_emits_a_name_once(spark, tmp_path):
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", at(0)), ("a", at(1)), ("b", at(2)), ("a", at(3))]
    spark.createDataFrame(rows, "name string, ts timestamp_ntz").coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema("name string, ts timestamp_ntz").parquet(folder)
    query = (
        jobs.stream_seen_dedup(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    assert sorted(r.name for r in spark.read.parquet(target).collect()) == ["a", "b"]


def test_seen_writes_of_stream_and_batch_agree(spark, tmp_path):
    """Seven micro-batches in order of time; names fall silent, come back after their state expired, and repeat within it."""
    folder, target, ckpt = (str(tmp_path / p) for p in ("in", "out", "ckpt"))
    rows = sorted((at((i * i * 7) % 1_000 + (i * 13) % 60 / 60), f"m{i % 11 if i % 5 else 99}") for i in range(700))
    schema = "ts timestamp_ntz, name string"
    os.makedirs(folder)
    found = jobs.stream_seen_writes(spark.readStream.schema(schema).parquet(folder), dt.timedelta(hours=1), dt.timedelta(seconds=30), dt.timedelta(0))
    for part in range(7):
        chosen = rows[part * 100 : part * 100 + 100]
        spark.createDataFrame(chosen, schema).coalesce(1).write.mode("append").parquet(folder)
        query = found.writeStream.format("parquet").option("checkpointLocation", ckpt).trigger(availableNow=True).start(target)
        query.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(target).collect()))
    batch = otlp.seen_dedup(spark.createDataFrame(rows, schema), dt.timedelta(hours=1), dt.timedelta(seconds=30))
    assert got == sorted(map(tuple, batch.collect())) and len(got) > 60


def test_seen_dedup_holds_no_list(spark):
    rows = spark.createDataFrame([("a", at(0))], "name string, ts timestamp_ntz")
    assert "collect_list" not in plan_of(otlp.seen_dedup(rows))
