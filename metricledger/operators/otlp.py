"""OTLP metrics: flattening, catalog rows, unused lookup and the drop filter.

The flat form has one row per exported metric: ``job, metric_name, data_type, is_monotonic,
description, unit, points``. Lookups fail open: whatever is not known to be unused is kept.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricledger.functions.scalars import (
    drop_active,
    epoch_seconds,
    from_epoch_seconds,
    otlp_prom_type,
    prom_metric_name,
    resolve_job,
)

# Series that must all be unused before a metric counts as unused.
VARIANTS = {"histogram": ("_bucket", "_count", "_sum"), "summary": ("", "_count", "_sum")}
# Extra catalog rows of a metric, as (suffix, keeps unit).
CATALOG_EXTRAS = {
    "histogram": (("_bucket", True), ("_sum", True), ("_count", False)),
    "summary": (("_sum", True), ("_count", False)),
}
FLUSH_EVERY = dt.timedelta(seconds=30)
SEEN_TTL = dt.timedelta(hours=1)


# ---- nested -> flat -----------------------------------------------------------------------
def flatten_otlp(exports: DataFrame) -> DataFrame:
    """One row per metric of every export. Resources and scopes without content give no rows."""
    carried = [c for c in exports.columns if c != "resource_metrics"]
    resources = exports.select(*carried, F.posexplode("resource_metrics").alias("resource", "rm"))
    scopes = resources.select(
        *carried,
        "resource",
        resolve_job(F.col("rm.attributes")).alias("job"),
        F.posexplode("rm.scope_metrics").alias("scope", "sm"),
    )
    return scopes.select(*carried, "resource", "scope", "job", F.explode("sm.metrics").alias("m")).select(
        *carried,
        "resource",
        "scope",
        "job",
        prom_metric_name(F.col("m.name"), F.col("m.data_type"), F.col("m.is_monotonic")).alias("metric_name"),
        "m.data_type",
        "m.is_monotonic",
        "m.description",
        "m.unit",
        _points(F.col("m")).alias("points"),
    )


def _points(metric: Column) -> Column:
    return F.coalesce(F.size(metric["data_points"]), F.lit(0)).cast("long")


def otlp_catalog_items(metrics: DataFrame) -> DataFrame:
    """Catalog rows of flat metrics: the metric itself, and the series its type adds."""
    carried = [
        c
        for c in metrics.columns
        if c not in ("metric_name", "data_type", "is_monotonic", "description", "unit", "points", "job")
    ]
    kind = otlp_prom_type(F.col("data_type"), F.col("is_monotonic"))

    def item(suffix: str, kind: Column, unit: bool) -> Column:
        return F.struct(
            F.concat("metric_name", F.lit(suffix)).alias("name"),
            kind.alias("type"),
            F.coalesce("description", F.lit("")).alias("help"),
            (F.coalesce(F.col("unit"), F.lit("")) if unit else F.lit("")).alias("unit"),
        )

    base = item("", kind, True)
    items = F.array(base)
    for name, extras in CATALOG_EXTRAS.items():
        types = ("histogram", "exponential_histogram") if name == "histogram" else (name,)
        more = [item(suffix, F.lit(name), unit) for suffix, unit in extras]
        items = F.when(F.col("data_type").isin(*types), F.array(base, *more)).otherwise(items)
    return metrics.where(F.col("metric_name") != "").select(*carried, F.inline(items))


# ---- unused lookup ------------------------------------------------------------------------
def otlp_unused(metrics: DataFrame, summary: DataFrame) -> DataFrame:
    """Names of exported metrics that are confirmed unused, each once.

    Distinct names come first, so a metric that makes up much of the traffic is one row in the
    lookup join.
    """
    needed = F.when(F.col("data_type") == "histogram", _variants("histogram"))
    needed = needed.when(F.col("data_type") == "summary", _variants("summary")).otherwise(F.array("metric_name"))
    names = metrics.where(F.col("metric_name") != "").select("metric_name", "data_type").distinct()
    flags = summary.select("name", "is_unused")
    return (
        names.select("metric_name", F.explode(needed).alias("name"))
        .join(flags, "name", "left")
        .groupBy("metric_name")
        .agg(F.bool_and(F.coalesce("is_unused", F.lit(False))).alias("all_unused"))
        .where("all_unused")
        .select("metric_name")
    )


def _variants(kind: str) -> Column:
    return F.array(*[F.concat("metric_name", F.lit(s)) for s in VARIANTS[kind]])


# ---- drop filter --------------------------------------------------------------------------
def _is_dropped(allow: Sequence[str], deny: Sequence[str]) -> Column:
    return (F.col("metric_name") == F.col("_unused")) & drop_active(F.col("job"), allow, deny)


def drop_unused(
    metrics: DataFrame, unused: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = ()
) -> DataFrame:
    """Flat metrics that pass the filter: not unused, or of a job where dropping is not active.
    Metrics without datapoints go too.

    Pass ``unused`` as a stored table: Spark then knows its size while it plans, and broadcasts
    it below ``spark.sql.autoBroadcastJoinThreshold``, so the traffic is not shuffled. Beyond that
    a hot metric is only hot on the traffic side, which the adaptive skew join splits.
    """
    names = unused.select(F.col("metric_name").alias("_unused"))
    return metrics.where(F.col("points") > 0).join(names, _is_dropped(allow, deny), "left_anti")


def dropped_metrics(
    metrics: DataFrame, unused: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = ()
) -> DataFrame:
    """Flat metrics that the filter drops for being unused."""
    names = unused.select(F.col("metric_name").alias("_unused"))
    return metrics.join(names, _is_dropped(allow, deny), "left_semi")


def mark_drops(
    metrics: DataFrame, unused: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = ()
) -> DataFrame:
    """Every flat metric with ``dropped``, in one pass; ``unused`` must hold each name once."""
    names = unused.select("metric_name").withColumn("_unused", F.lit(True))
    hit = F.coalesce(F.col("_unused"), F.lit(False))
    return (
        metrics.join(names, "metric_name", "left")
        .withColumn("dropped", hit & drop_active(F.col("job"), allow, deny))
        .drop("_unused")
    )


def drop_unused_nested(
    exports: DataFrame,
    unused: DataFrame,
    allow: Sequence[str] = (),
    deny: Sequence[str] = (),
    key: str = "export_id",
) -> DataFrame:
    """The same on export trees, with emptied scopes and resources pruned.

    The unused names an export holds are joined to it; their number is bounded by the export itself. Only names that may be
    dropped are looked up. The names are hashed and the trees pass by, so these are neither sorted nor spilled. Exports that
    end up empty have no resources left. On a stream this runs inside each batch, see ``stream_drop_unused``.
    """
    droppable = (F.col("points") > 0) & drop_active(F.col("job"), allow, deny)
    present = flatten_otlp(exports.select(key, "resource_metrics")).where(droppable).select(key, "metric_name").distinct()
    hits = (
        present.join(unused.select("metric_name"), "metric_name")
        .groupBy(key)
        .agg(F.collect_list("metric_name").alias("_unused"))
    )
    held = F.coalesce(F.col("_unused"), F.array().cast("array<string>"))
    trees = _pruned(lambda n: F.array_contains(held, n), allow, deny)
    return exports.join(hits.hint("shuffle_hash"), key, "left").withColumn("resource_metrics", trees).drop("_unused")


def _pruned(is_unused: Callable[[Column], Column], allow: Sequence[str], deny: Sequence[str]) -> Column:
    """``resource_metrics`` without unused or empty metrics, and without what that leaves empty."""

    def keep(job: Column) -> Callable[[Column], Column]:
        def one(m: Column) -> Column:
            name = prom_metric_name(m["name"], m["data_type"], m["is_monotonic"])
            return ~(drop_active(job, allow, deny) & is_unused(name)) & (_points(m) > 0)

        return one

    def scope(sm: Column, job: Column) -> Column:
        return F.struct(sm["scope"].alias("scope"), F.filter(sm["metrics"], keep(job)).alias("metrics"))

    def resource(rm: Column) -> Column:
        job = resolve_job(rm["attributes"])
        scopes = F.transform(rm["scope_metrics"], lambda sm: scope(sm, job))
        return F.struct(
            rm["attributes"].alias("attributes"),
            F.filter(scopes, lambda sm: F.size(sm["metrics"]) > 0).alias("scope_metrics"),
        )

    return F.filter(F.transform("resource_metrics", resource), lambda rm: F.size(rm["scope_metrics"]) > 0)


def drop_named(metrics: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """Flat metrics whose name is neither listed nor starts with a prefix."""
    name = F.col("metric_name")
    dropped = name.isin(*names) if names else F.lit(False)
    for prefix in prefixes:
        dropped = dropped | name.startswith(prefix)
    return metrics.where(~dropped)


def point_counts(
    metrics: DataFrame, unused: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = ()
) -> DataFrame:
    """Datapoints received and dropped, by reason."""
    points = F.sum("points")
    dropped = F.sum(F.when(F.col("dropped"), F.col("points")).otherwise(F.lit(0)))
    counted = mark_drops(metrics, unused, allow, deny).agg(
        F.coalesce(points, F.lit(0)).alias("received"), F.coalesce(dropped, F.lit(0)).alias("dropped")
    )
    return counted.select(F.lit("unused_metric").alias("reason"), "received", "dropped")


def dry_run(
    metrics: DataFrame, unused: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = ()
) -> DataFrame:
    """What the filter would drop: metrics and datapoints."""
    return dropped_metrics(metrics, unused, allow, deny).agg(
        F.count(F.lit(1)).alias("metrics"), F.coalesce(F.sum("points"), F.lit(0)).alias("datapoints")
    )


def missing_jobs(metrics: DataFrame) -> DataFrame:
    """Rows whose resource names no job."""
    return metrics.agg(F.count_if(F.col("job") == "").alias("missing"))


# ---- catalog emission ---------------------------------------------------------------------
def seen_dedup(
    items: DataFrame, ttl: dt.timedelta = SEEN_TTL, tick: dt.timedelta = FLUSH_EVERY, ts: str = "ts"
) -> DataFrame:
    """(name, flush) for every catalog write: a sighting is written at its flush tick unless the
    name was written less than ``ttl`` before.

    Sightings reduce to distinct ticks by hash aggregation first. Ticks are then walked in order of name and time within their
    partitions; all that is held is the last write of the name at hand, however long the data's time span.
    """
    step, life = int(tick.total_seconds()), int(ttl.total_seconds())
    ticks = items.select("name", tick_of(F.col(ts), step).alias("tick")).distinct()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, last = None, None
        for b in batches:
            due = []
            for i, (own, at) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if own != name or last is None or at - last >= life:
                    due.append(i)
                    name, last = own, at
            yield b.take(pa.array(due, pa.int64()))

    in_order = ticks.repartition("name").sortWithinPartitions("name", "tick")
    return in_order.mapInArrow(walk, "name string, tick long").select("name", from_epoch_seconds(F.col("tick")).alias("flush"))


def tick_of(ts: Column, step: int) -> Column:
    """The flush tick of an instant, in epoch seconds."""
    return (F.floor(epoch_seconds(ts) / F.lit(step)) * F.lit(step)).cast("long")
