"""Structured Streaming jobs."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metricledger import schemas
from metricledger.functions.scalars import from_epoch_seconds
from metricledger.operators import enrich, otlp, upserts
from metricledger.operators.validate import check_queries
from metricledger.plans.inventory import Snapshot, Tables
from metricledger.sources.dictionary_runs import DictionaryRuns
from metricledger.sources.query_log import identity_bloom, parse_query_push, utc_now
from metricledger.streaming import log_days

LOG_COLUMNS = [name for name in schemas.QUERY_LOG.names if name != "dt"]


def _start(writer, trigger: dict) -> StreamingQuery:
    return writer.trigger(**(trigger or {"availableNow": True})).start()


REJECTS = "received timestamp_ntz, record string, error string, dt date, batch_id long"
REJECTED = [column.split()[0] for column in REJECTS.split(", ")]


def stream_query_log(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    rejects: str,
    dictionary: str,
    max_files: int = 1_000,
    trigger: dict | None = None,
    metrics: str | None = None,
    closed: str | None = None,
    keep: dt.timedelta | None = None,
) -> StreamingQuery:
    """Pushed JSON files -> validated, enriched log, partitioned by day and batch; what is refused goes to ``rejects``.

    The time of receipt is a column of the streaming plan, so Spark fixes it for a batch and repeats it with the batch. Log,
    rejects and new dictionary rows overwrite the folders of their batch: a repeated batch, on whatever
    day, leaves no duplicates. The dictionary (:class:`DictionaryRuns`) is asked for the batch's texts first, so only new texts are
    described. Records of log and rejects add up to the input. The source limits how much a batch takes; nothing is dropped
    when input is faster. ``metrics`` is a folder for the metric log of the same records. With ``closed``, a batch also closes the
    days before its own (:mod:`log_days`), in ``closed/log`` and ``closed/metrics``, and ``keep`` deletes what is older than that.
    A dictionary belongs to the checkpoint it was begun with.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(source)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), utc_now().alias("received"))
    words = DictionaryRuns(spark, dictionary)

    def write(batch: DataFrame, batch_id: int) -> None:
        placed = batch.withColumn("line", F.monotonically_increasing_id())
        parsed = parse_query_push(placed, received=F.col("received"))
        checked = check_queries(parsed.withColumnRenamed("error", "refused"), F.col("received"))
        checked = checked.withColumns({"error": F.coalesce("refused", "error"), "dt": F.to_date("received"), "batch_id": F.lit(batch_id).cast("long")}).persist()
        held = [checked]
        try:
            valid = checked.where("error IS NULL")
            words.settle(batch_id)
            found = words.known(enrich.distinct_texts(valid), batch_id).persist()
            held.append(found)
            found.count()  # both branches of the dictionary read it; without it each would work it out
            fresh = words.add(enrich.expression_dictionary(found.where("part IS NULL")), batch_id)
            every = found.where("part IS NOT NULL").drop("part").unionByName(fresh)
            key = F.xxhash64("file", "batch_id", "line", "position").alias("query_id")
            named = enrich.enrich(valid.withColumn("query_id", key), every).select(*LOG_COLUMNS, "dt", "batch_id").persist()
            held.append(named)
            _replace(named.sortWithinPartitions("ts"), target, ["dt", "batch_id"], identity_bloom())
            if metrics:
                rows = enrich.metric_log(named).withColumns({"dt": F.to_date("ts"), "batch_id": F.lit(batch_id).cast("long")})
                _replace(rows.sortWithinPartitions("metric", "ts"), metrics, ["dt", "batch_id"])
            _replace(checked.where("error IS NOT NULL").select(*REJECTED), rejects, ["dt", "batch_id"])
            today = checked.agg(F.max("dt")).first()[0] if closed else None
            if today:
                log_days.close_finished(spark, target, f"{closed}/log", today, keep=keep)
                if metrics:
                    log_days.close_finished(spark, metrics, f"{closed}/metrics", today, ("metric", "ts"), keep)
        finally:
            for rows in held:
                rows.unpersist()

    return _start(lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)


def _replace(rows: DataFrame, path: str, parts: list[str], options: dict[str, str] | None = None) -> None:
    """Overwrites only the folders that the rows belong to."""
    writer = rows.write.mode("overwrite").options(partitionOverwriteMode="dynamic", **(options or {}))
    writer.partitionBy(*parts).parquet(path)


def stream_rollup(stream: DataFrame, stride: dt.timedelta, delay: dt.timedelta | None = None) -> DataFrame:
    """Per-bucket counts of a log stream: total, success, errors, duration sum.

    A bucket is final once the watermark has passed it; rows later than that are dropped. The
    delay defaults to one stride.
    """
    span = f"{int(stride.total_seconds())} seconds"
    late = f"{int((delay or stride).total_seconds())} seconds"
    code = F.col("status_code")
    return (
        stream.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", span))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(code.between(200, 299)).alias("status_2xx"),
            F.count_if(code.between(400, 499)).alias("status_4xx"),
            F.count_if(code.between(500, 599)).alias("status_5xx"),
            F.sum("duration_ms").alias("duration_sum"),
        )
        .select(F.col("window.start").alias("time"), "total", "status_2xx", "status_4xx", "status_5xx", "duration_sum")
    )


def stream_drop_unused(
    exports: DataFrame, root: str, target: str, checkpoint: str, allow=(), deny=(), trigger: dict | None = None
) -> StreamingQuery:
    """The drop filter on a stream of export trees. Each batch reads the newest usage summary, so a metric that becomes used is
    kept from the next batch on, and looks up only the names that it holds itself.

    Trees are read again for the names and for the lookup, not held: a cached tree takes some twenty times its bytes in a file. The
    source limits how much a batch takes, and with it what a task reads."""

    def write(batch: DataFrame, batch_id: int) -> None:
        summary = Tables(batch.sparkSession, root).read("metrics_usage_summary")
        unused = otlp.otlp_unused(otlp.flatten_otlp(batch), summary)
        kept = otlp.drop_unused_nested(batch, unused, allow, deny)
        _replace(kept.withColumn("batch_id", F.lit(batch_id).cast("long")), target, ["batch_id"])

    return _start(exports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)


def stream_seen_dedup(items: DataFrame, ttl: dt.timedelta = otlp.SEEN_TTL, ts: str = "ts") -> DataFrame:
    """Catalog rows whose name was not seen within the watermark delay.

    Expiry follows the watermark, so a name may come again a little later than ``ttl`` after
    its last write; the batch form is exact. All sightings of a name meet in its state's task:
    for traffic with hot names use :func:`stream_catalog_sync`, which reduces them first.
    """
    timed = items.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.withWatermark(ts, f"{int(ttl.total_seconds())} seconds").dropDuplicatesWithinWatermark(["name"])


def stream_seen_writes(
    items: DataFrame,
    ttl: dt.timedelta = otlp.SEEN_TTL,
    tick: dt.timedelta = otlp.FLUSH_EVERY,
    lateness: dt.timedelta = dt.timedelta(minutes=5),
    ts: str = "ts",
) -> DataFrame:
    """(name, flush) for every catalog write, as :func:`otlp.seen_dedup` gives them, on a stream.

    State of a name is the instant of its last write; it expires by event time when the next sighting is due in any case, so what is held are
    the names of one ``ttl``. Ticks within a micro-batch are taken in order, so the result is that of the batch form for records
    that come in order between micro-batches. A record that is older than the last write of its name is not due.
    """
    step, life = int(tick.total_seconds()), int(ttl.total_seconds())
    timed = items.select("name", F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", f"{int(lateness.total_seconds())} seconds")
    ticks = timed.select("name", "ts", otlp.tick_of(F.col("ts").cast("timestamp_ntz"), step).alias("tick"))

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        due = []
        for at in sorted({int(t) for chunk in chunks for t in chunk["tick"].unique()}):
            if last is None or at - last >= life:
                due.append(at)
                last = at
        state.update((last,))
        state.setTimeoutTimestamp(max((last + life + step) * 1_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"name": [key[0]] * len(due), "tick": pd.Series(due, dtype="int64")})

    found = ticks.groupBy("name").applyInPandasWithState(run, "name string, tick long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("name", from_epoch_seconds(F.col("tick")).alias("flush"))


def due_items(metrics: DataFrame, catalog: DataFrame, ttl: dt.timedelta) -> DataFrame:
    """Catalog rows to write for a batch of flat metrics with ``ts``: those the catalog does not have,
    or has not had confirmed for ``ttl``.

    Sightings of a metric are reduced to one row by hash aggregation on the map side.
    """
    sighted = metrics.groupBy("metric_name", "data_type", "is_monotonic", "description", "unit").agg(
        F.max(F.col("ts").cast("timestamp_ntz")).alias("synced_at")
    )
    items = otlp.otlp_catalog_items(sighted).groupBy("name").agg(
        F.max_by(F.struct("type", "help", "unit"), F.struct("synced_at", "type", "help", "unit")).alias("item"),
        F.max("synced_at").alias("synced_at"),
    )
    last = catalog.select("name", "last_synced_at")
    age = F.col("synced_at") - F.col("last_synced_at")
    wait = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(ttl.total_seconds())).cast("decimal(18,6)"))
    return (
        items.join(last, "name", "left")
        .where(F.col("last_synced_at").isNull() | (age >= wait))
        .select("name", "item.type", "item.help", "item.unit", "synced_at")
    )


def stream_catalog_sync(
    metrics: DataFrame, root: str, checkpoint: str, ttl: dt.timedelta = otlp.SEEN_TTL, trigger: dict | None = None
) -> StreamingQuery:
    """Flat metrics with ``ts`` -> catalog and placeholders, as new snapshots when something is due.

    The catalog itself remembers what was seen, so nothing is held between batches and a restart
    forgets nothing. The upserts are idempotent: a retried batch repeats the same result, which
    takes the place of re-queueing after a failed flush.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        tables = Tables(batch.sparkSession, root)
        held = batch.persist()

        def change(there: Snapshot) -> dict[str, DataFrame]:
            catalog = there.read("metrics_catalog")
            due = due_items(held, catalog, ttl)
            now = due.agg(F.max("synced_at").alias("now")).first().now
            if now is None:
                return {}
            return {
                "metrics_usage_summary": upserts.add_placeholders(there.read("metrics_usage_summary"), due, now),
                "metrics_catalog": upserts.upsert_catalog(catalog, due.withColumn("seq", F.col("synced_at"))),
            }

        try:
            tables.update(change)
        finally:
            held.unpersist()

    return _start(metrics.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)
