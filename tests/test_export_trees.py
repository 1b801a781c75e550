"""Export trees at scale: what is shuffled, sorted and held while they are built and filtered."""

from pathlib import Path

from pyspark.sql import functions as F

from metricledger import fixtures as fx
from metricledger import registry
from metricledger.operators import otlp
from metricledger.session import shared_folder
from metricledger.streaming import jobs
from tests.conftest import plan_of


def test_lines_are_grouped_before_they_become_trees(spark, sf):
    plan = plan_of(fx._otlp_exports(spark, sf))
    grouped = [line for line in plan.splitlines() if "collect_list(" in line and "partial_" in line]
    assert grouped and not any("service.name" in line or "data_points" in line for line in grouped)


def test_trees_hold_what_their_lines_say(spark, sf):
    flat = fx.otlp_rows(fx.table(spark, sf, "lineitem"))
    said = flat.select("export_id", "name", "unit", F.to_json("attributes").alias("attributes"), (F.col("value") % 4).cast("int").alias("points"), "ts")
    m = F.col("r.scope_metrics")[0]["metrics"][0]
    at = F.when(F.size(m["data_points"]) > 0, m["data_points"][0]["ts"])
    held = fx._otlp_exports(spark, sf).select("export_id", F.explode("resource_metrics").alias("r")).select(
        "export_id", m["name"].alias("name"), m["unit"].alias("unit"), F.to_json("r.attributes").alias("attributes"), F.size(m["data_points"]).alias("points"), at.alias("ts")
    )
    said = said.withColumn("ts", F.when(F.col("points") > 0, F.col("ts")))
    assert said.count() == held.count() > 0
    assert said.exceptAll(held).isEmpty() and held.exceptAll(said).isEmpty()


def test_trees_pass_by_the_hashed_names(spark, sf):
    """Neither sorted nor spilled on the way to the names; names that no job may drop are not looked up."""
    plan = plan_of(otlp.drop_unused_nested(fx.otlp_exports(spark, sf), fx.unused_names(spark, sf), registry.ALLOW, registry.DENY))
    assert "ShuffledHashJoin [export_id" in plan
    assert not any("Sort [export_id" in line for line in plan.splitlines())


def test_streamed_trees_come_in_batches_and_are_not_held(spark, sf, monkeypatch):
    want = sorted(map(tuple, registry.queries()["otlp_drop_unused_nested"](spark, sf).collect()), key=str)
    batches, write = [], jobs._replace

    def counted(rows, *args):
        batches.append(rows.sparkSession.sparkContext._jsc.getPersistentRDDs().size())
        write(rows, *args)

    monkeypatch.setattr(registry, "BATCH_BYTES", 1)
    monkeypatch.setattr(jobs, "_replace", counted)
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = sorted(map(tuple, registry.queries()["stream_drop_unused"](spark, sf).collect()), key=str)
    assert got == want
    assert batches and set(batches) == {held}
    assert len(batches) == len(spark.read.parquet(_newest(spark, "drop_exports")).inputFiles())


def _newest(spark, name):
    return str(max(Path(shared_folder(spark)).glob(f"{name}-*"), key=lambda p: p.stat().st_mtime))
