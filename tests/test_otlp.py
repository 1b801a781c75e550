import datetime as dt

import pytest

from pyspark.sql import functions as F

from metricledger import schemas
from metricledger.operators import otlp
from metricledger.plans.inventory import Tables
from metricledger.streaming import jobs
from tests.conftest import BASE, plan_of

FLAT = "metric_name string, data_type string, is_monotonic boolean, job string, points long"


@pytest.fixture()
def flat(spark):
    def make(*rows):
        return spark.createDataFrame([(n, t, False, j, p) for n, t, j, p in rows], FLAT)

    return make


@pytest.fixture()
def flags(spark):
    def make(**known):
        return spark.createDataFrame(list(known.items()) or [("", False)], "name string, is_unused boolean")

    return make


def unused(flat_rows, known):
    return sorted(r.metric_name for r in otlp.otlp_unused(flat_rows, known).collect())


def test_used_and_unknown_metrics_stay(flat, flags):
    rows = flat(("idle", "gauge", "j", 1), ("busy", "gauge", "j", 1), ("who", "gauge", "j", 1))
    assert unused(rows, flags(idle=True, busy=False)) == ["idle"]


@pytest.mark.parametrize(
    "kind, known, dropped",
    [
        ("histogram", {"m_bucket": True, "m_count": True, "m_sum": True}, True),
        ("histogram", {"m_bucket": True, "m_count": False, "m_sum": True}, False),
        ("histogram", {"m_bucket": True, "m_count": True}, False),
        ("histogram", {"m": True}, False),
        ("exponential_histogram", {"m": True}, True),
        ("exponential_histogram", {"m_bucket": True, "m_count": True, "m_sum": True}, False),
        ("summary", {"m": True, "m_count": True, "m_sum": True}, True),
        ("summary", {"m": False, "m_count": True, "m_sum": True}, False),
        ("summary", {"m_count": True, "m_sum": True}, False),
        ("gauge", {"m": None}, False),
    ],
)
def test_variants(flat, flags, kind, known, dropped):
    assert unused(flat(("m", kind, "j", 1)), flags(**known)) == (["m"] if dropped else [])


@pytest.mark.parametrize(
    "allow, deny, kept",
    [((), (), []), (("a",), (), ["b", ""]), ((), ("a",), ["a"]), (("a", "b"), ("a",), ["a", ""]), (("",), (), ["a", "b"])],
)
def test_job_scope(spark, flat, allow, deny, kept):
    rows = flat(("idle", "gauge", "a", 2), ("idle", "gauge", "b", 3), ("idle", "gauge", "", 5))
    names = spark.createDataFrame([("idle",)], "metric_name string")
    twice = names.union(names)
    assert otlp.drop_unused(rows, twice, allow, deny).count() == len(kept)
    assert otlp.dry_run(rows, twice, allow, deny).first().metrics == 3 - len(kept)
    got = otlp.drop_unused(rows, names, allow, deny)
    assert sorted(r.job for r in got.collect()) == sorted(kept)
    sizes = {"a": 2, "b": 3, "": 5}
    lost = sum(v for j, v in sizes.items() if j not in kept)
    counts = otlp.point_counts(rows, names, allow, deny).first()
    assert (counts.received, counts.dropped) == (10, lost)
    would = otlp.dry_run(rows, names, allow, deny).first()
    assert (would.metrics, would.datapoints) == (3 - len(kept), lost)
    assert otlp.missing_jobs(rows).first().missing == 1


def test_names_found_in_the_same_traffic(flat, flags):
    rows = flat(("idle", "gauge", "a", 1), ("busy", "gauge", "a", 1))
    names = otlp.otlp_unused(rows, flags(idle=True, busy=False))
    assert [r.metric_name for r in otlp.drop_unused(rows, names).collect()] == ["busy"]
    assert otlp.dry_run(rows, names).first().metrics == 1
    assert otlp.point_counts(rows, names).first().dropped == 1


def test_metrics_without_points_are_pruned_not_counted(spark, flat):
    rows = flat(("empty", "gauge", "a", 0), ("idle", "gauge", "a", 0))
    names = spark.createDataFrame([("idle",)], "metric_name string")
    assert otlp.drop_unused(rows, names).count() == 0
    assert otlp.point_counts(rows, names).first().dropped == 0
    assert otlp.drop_named(rows, ["empty"]).count() == 1
    assert otlp.drop_named(rows, prefixes=["id", "x"]).count() == 1


def export(spark, *resources):
    def metric(name, kind, points):
        return (name, "d", "u", kind, kind == "sum", [(BASE, 1.0)] * points)

    tree = [(attrs, [("s", [metric(*m) for m in scope]) for scope in scopes]) for attrs, scopes in resources]
    return spark.createDataFrame([(1, tree)], schemas.OTLP_EXPORT)


def test_nested_pruning(spark):
    trees = export(
        spark,
        ({"job": "a"}, [[("idle", "gauge", 1)], [("busy", "gauge", 1), ("idle", "gauge", 1), ("hollow", "gauge", 0)]]),
        ({"service.name": "b"}, [[("idle", "gauge", 2)]]),
        ({"job": "", "service.name": "c"}, [[("calls", "sum", 1)], []]),
    )
    names = spark.createDataFrame([("idle",), ("calls_total",)], "metric_name string")
    left = otlp.drop_unused_nested(trees, names).first().resource_metrics
    assert [(r.attributes["job"], [[m.name for m in s.metrics] for s in r.scope_metrics]) for r in left] == [("a", [["busy"]])]
    spared = otlp.drop_unused_nested(trees, names, deny=["b"]).first().resource_metrics
    assert [r.attributes.get("service.name") for r in spared] == [None, "b"]
    untouched = otlp.drop_unused_nested(trees, names.limit(0)).first().resource_metrics
    assert len(untouched) == 3


def test_flatten(spark):
    trees = export(spark, ({"job": "a"}, [[("calls", "sum", 2), ("calls_total", "sum", 1), ("h", "histogram", 0)]]), ({}, []))
    got = [(r.metric_name, r.job, r.points) for r in otlp.flatten_otlp(trees).collect()]
    assert got == [("calls_total", "a", 2), ("calls_total", "a", 1), ("h", "a", 0)]
    items = {(r.name, r.type, r.unit) for r in otlp.otlp_catalog_items(otlp.flatten_otlp(trees)).collect()}
    assert items == {
        ("calls_total", "counter", "u"),
        ("h", "histogram", "u"),
        ("h_bucket", "histogram", "u"),
        ("h_sum", "histogram", "u"),
        ("h_count", "histogram", ""),
    }


def greedy(times, ttl, tick):
    """Written flush ticks of one name, by the rule itself."""
    out = []
    for t in sorted(times):
        at = t - t % tick
        if not out or (at != out[-1] and at - out[-1] >= ttl):
            out.append(at)
    return out


def test_seen_dedup_against_the_rule(spark):
    rows = [(f"m{i % 3}", BASE + dt.timedelta(seconds=(i * 7919) % 20_000)) for i in range(900)]
    df = spark.createDataFrame(rows, "name string, ts timestamp_ntz")
    got = {}
    for r in otlp.seen_dedup(df, dt.timedelta(hours=1), dt.timedelta(seconds=30)).collect():
        got.setdefault(r.name, []).append(int((r.flush - BASE).total_seconds()))
    want = {
        name: greedy([int((t - BASE).total_seconds()) for n, t in rows if n == name], 3600, 30) for name in ("m0", "m1", "m2")
    }
    assert {n: sorted(v) for n, v in got.items()} == want


def test_hot_metric_is_not_shuffled(spark, flat, tmp_path):
    """A stored, small set of names is broadcast; the traffic stays where it is."""
    path = str(tmp_path / "names")
    spark.createDataFrame([("idle",)], "metric_name string").write.parquet(path)
    traffic = spark.range(1000).selectExpr("concat('idle', id % 2) AS metric_name", "'a' AS job", "id AS points")
    plan = plan_of(otlp.drop_unused(traffic, spark.read.parquet(path)))
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_stream_filter_follows_the_summary(spark, tmp_path):
    """Many unused names, and one that becomes used while the stream goes on."""
    root, source, target, ckpt = (str(tmp_path / n) for n in ("tables", "in", "out", "ckpt"))
    tables = Tables(spark, root)

    def summary(unused):
        flags = [(f"m{i}", i in unused) for i in range(2_500)]
        zero = [F.lit(0).cast("long").alias(c) for c in ("alert_count", "record_count", "dashboard_count", "query_count")]
        no_time = [F.lit(None).cast("timestamp_ntz").alias(c) for c in ("last_queried_at", "updated_at")]
        tables.write("metrics_usage_summary", spark.createDataFrame(flags, "name string, is_unused boolean").select("name", *zero, *no_time, "is_unused"))

    def send(export_id):
        tree = export(spark, ({"job": "a"}, [[(f"m{i}", "gauge", 1) for i in range(2_500)]]))
        tree.withColumn("export_id", F.lit(export_id).cast("long")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(tree.schema).parquet(source)
        jobs.stream_drop_unused(stream, root, target, ckpt).awaitTermination()

    summary(set(range(2_400)))
    send(1)
    summary(set(range(2_399)))
    send(2)
    kept = otlp.flatten_otlp(spark.read.schema(schemas.OTLP_EXPORT).parquet(target))
    names = {i: {r.metric_name for r in kept.where(F.col("export_id") == i).collect()} for i in (1, 2)}
    assert names == {1: {f"m{i}" for i in range(2_400, 2_500)}, 2: {f"m{i}" for i in range(2_399, 2_500)}}
