import datetime as dt
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from metricledger import schemas
from metricledger.functions.expr_tools import ntz
from metricledger.operators import upserts
from metricledger.params import PageRequest, TimeRange
from metricledger.plans import inventory, metadata, reads, summary, usage
from metricledger.sources import catalog_feeds
from tests.conftest import BASE

DAY = dt.timedelta(days=1)
WINDOW = TimeRange(BASE - 30 * DAY, BASE)


@pytest.fixture()
def empty(spark):
    return lambda schema: spark.createDataFrame([], schema)


@pytest.fixture()
def rule_push(spark):
    def make(*rows):
        schema = (
            "serie string, group_name string, name string, expression string, kind string, labels array<string>, "
            "seen_at timestamp_ntz"
        )
        return spark.createDataFrame(list(rows), schema)

    return make


@pytest.fixture()
def dashboard_push(spark):
    def make(*rows):
        schema = "id string, serie string, name string, url string, seen_at timestamp_ntz, seq long"
        return spark.createDataFrame(list(rows), schema)

    return make


def test_label_order_makes_no_new_rule(empty, rule_push):
    first = rule_push(("up", "g", "r", "e", "alert", ["l2", "l1"], BASE - DAY))
    second = rule_push(("up", "g", "r", "e", "alert", ["l1", "l2"], BASE))
    rules = upserts.upsert_rules(upserts.upsert_rules(empty(schemas.RULES_USAGE), first), second)
    (row,) = rules.collect()
    assert row.labels == ["l1", "l2"]
    assert (row.created_at, row.first_seen_at, row.last_seen_at) == (BASE - DAY, BASE - DAY, BASE)


def test_missing_labels_are_an_empty_list(empty, rule_push):
    rules = upserts.upsert_rules(empty(schemas.RULES_USAGE), rule_push(("up", "g", "r", "e", "alert", None, BASE)))
    assert rules.first().labels == []


def test_latest_rule_version(empty, rule_push):
    push = rule_push(
        ("up", "g", "r", "old", "alert", [], BASE - DAY),
        ("up", "g", "r", "new", "alert", [], BASE),
        ("up", "g", "s", "x", "record", [], BASE),
    )
    rules = upserts.upsert_rules(empty(schemas.RULES_USAGE), push)
    page = usage.rules_usage(rules, WINDOW, "alert", "up")
    assert [r.expression for r in page.data.collect()] == ["new"]
    assert page.counts.first().total == 1
    filtered = usage.rules_usage(rules, WINDOW, "alert", "up", PageRequest(filter="OLD"))
    assert [r.expression for r in filtered.data.collect()] == ["old"]
    assert usage.rules_usage(rules, WINDOW, "alert", "down").counts.first().total == 0


def test_dashboard_rename_wins(empty, dashboard_push):
    first = dashboard_push(("d", "up", "Old", "u1", BASE - DAY, 1))
    second = dashboard_push(("d", "up", "Mid", "u2", BASE, 2), ("d", "up", "New", "u3", BASE, 3))
    table = upserts.upsert_dashboards(upserts.upsert_dashboards(empty(schemas.DASHBOARD_USAGE), first), second)
    (row,) = table.collect()
    assert (row.name, row.url, row.first_seen_at, row.last_seen_at) == ("New", "u3", BASE - DAY, BASE)
    page = usage.dashboard_usage(table, WINDOW, "up")
    assert [r.name for r in page.data.collect()] == ["New"]


def test_presence_window(empty, dashboard_push):
    push = dashboard_push(("d", "up", "n", "u", BASE - 40 * DAY, 1), ("d", "up", "n", "u", BASE - 35 * DAY, 2))
    table = upserts.upsert_dashboards(empty(schemas.DASHBOARD_USAGE), push)
    assert summary.dashboard_counts(table, WINDOW).count() == 0
    touching = TimeRange(BASE - 35 * DAY, BASE)
    assert summary.dashboard_counts(table, touching).first().dashboard_count == 1


def test_statistics_count_dashboards_by_name(empty, rule_push, dashboard_push):
    rules = upserts.upsert_rules(
        empty(schemas.RULES_USAGE),
        rule_push(("up", "g", "r", "e", "alert", [], BASE), ("x", "g", "r", "e", "record", [], BASE)),
    )
    dashboards = upserts.upsert_dashboards(
        empty(schemas.DASHBOARD_USAGE),
        dashboard_push(("1", "up", "same", "u", BASE, 1), ("2", "up", "same", "u", BASE, 2), ("3", "x", "n", "u", BASE, 3)),
    )
    row = reads.metric_statistics(rules, dashboards, "up", WINDOW).first().asDict()
    assert row == {
        "alert_count": 1,
        "record_count": 0,
        "dashboard_count": 1,
        "total_alerts": 1,
        "total_records": 1,
        "total_dashboards": 2,
    }
    assert {r.name: r.dashboard_count for r in summary.dashboard_counts(dashboards, WINDOW).collect()} == {"up": 2, "x": 1}


def catalog_of(spark, *rows):
    full = [(n, t, h, u, at, at) for n, t, h, u, at in rows]
    return spark.createDataFrame(full, schemas.METRICS_CATALOG)


def test_metadata_expansion(spark):
    meta = spark.createDataFrame(
        [("h", "histogram", "H", "s"), ("q", "summary", "Q", "s"), ("u", "unknown", "U", "")],
        "name string, type string, help string, unit string",
    )
    rows = {r.name: (r.type, r.help, r.unit) for r in catalog_feeds.catalog_from_metadata(meta).collect()}
    assert rows == {
        "h_bucket": ("histogram_bucket", "H (histogram buckets)", "s"),
        "h_count": ("histogram_count", "H (histogram count)", ""),
        "h_sum": ("histogram_sum", "H (histogram sum)", "s"),
        "q": ("summary", "Q", "s"),
        "q_count": ("summary_count", "Q (summary count)", ""),
        "q_sum": ("summary_sum", "Q (summary sum)", "s"),
        "u": ("unknown", "U", ""),
    }


def test_first_info_counts(spark):
    meta = spark.createDataFrame(
        [("m", [("gauge", "a", ""), ("counter", "b", "")]), ("none", [])],
        "name string, infos array<struct<type:string,help:string,unit:string>>",
    )
    assert [tuple(r) for r in catalog_feeds.first_info(meta).collect()] == [("m", "gauge", "a", "")]


def test_names_must_be_utf8(spark):
    names = spark.range(1).selectExpr("explode(array('ok', 'ok', cast(unhex('C328') as string))) AS name")
    assert [r.name for r in catalog_feeds.catalog_from_names(names).collect()] == ["ok"]


def test_catalog_upsert_keeps_first_sighting(spark):
    target = catalog_of(spark, ("a", "gauge", "old", "", BASE - DAY), ("b", "gauge", "b", "", BASE - DAY))
    source = spark.createDataFrame(
        [("a", "counter", "lost", "", BASE, 1), ("a", "counter", "new", "s", BASE, 2), ("c", "gauge", "c", "", BASE, 3)],
        "name string, type string, help string, unit string, synced_at timestamp_ntz, seq long",
    )
    rows = {r.name: r for r in upserts.upsert_catalog(target, source).collect()}
    assert (rows["a"].help, rows["a"].first_seen_at, rows["a"].last_synced_at) == ("new", BASE - DAY, BASE)
    assert rows["b"].last_synced_at == BASE - DAY
    assert rows["c"].first_seen_at == BASE


def summary_of(spark, *rows):
    full = [(n, a, r, d, q, None, BASE, unused) for n, a, r, d, q, unused in rows]
    return spark.createDataFrame(full, schemas.USAGE_SUMMARY)


def test_placeholder_never_overwrites(spark):
    old = summary_of(spark, ("a", 1, 0, 0, 0, False))
    names = spark.createDataFrame([("a",), ("b",), ("b",)], "name string")
    rows = {r.name: (r.alert_count, r.is_unused) for r in upserts.add_placeholders(old, names, BASE).collect()}
    assert rows == {"a": (1, False), "b": (0, False)}


def test_stale_rows_keep_their_summary(spark, empty, make_log):
    catalog = catalog_of(spark, ("up", "gauge", "", "", BASE), ("stale", "gauge", "", "", BASE - 90 * DAY))
    target = summary_of(spark, ("up", 0, 0, 0, 0, False), ("stale", 0, 0, 0, 0, False))
    refreshed = summary.usage_summary(
        catalog, empty(schemas.RULES_USAGE), empty(schemas.DASHBOARD_USAGE), make_log({}, {}), WINDOW
    )
    merged = {r.name: (r.query_count, r.is_unused) for r in upserts.merge_summary(target, refreshed).collect()}
    assert merged == {"up": (2, False), "stale": (0, False)}
    assert not summary.summary_noop_check(catalog, refreshed).first().was_noop
    assert summary.summary_noop_check(catalog, refreshed.limit(0)).first().was_noop


def test_unused_flag_and_backfill(spark, empty, make_log):
    catalog = catalog_of(spark, ("idle", "gauge", "", "", BASE))
    refreshed = summary.usage_summary(
        catalog, empty(schemas.RULES_USAGE), empty(schemas.DASHBOARD_USAGE), make_log({}), WINDOW
    )
    assert refreshed.first().is_unused
    flags = upserts.backfill_is_unused(summary_of(spark, ("a", 0, 0, 0, 0, False), ("b", 0, 1, 0, 0, True)))
    assert {r.name: r.is_unused for r in flags.collect()} == {"a": True, "b": False}


def test_job_index_refreshes(spark):
    old = spark.createDataFrame([("m", "j", BASE - DAY)], schemas.JOB_INDEX)
    new = spark.createDataFrame([("m", "j", BASE), ("m", "k", BASE)], schemas.JOB_INDEX)
    rows = {(r.name, r.job): r.updated_at for r in upserts.upsert_job_index(old, new).collect()}
    assert rows == {("m", "j"): BASE, ("m", "k"): BASE}
    assert [r.job for r in reads.list_jobs(upserts.upsert_job_index(old, new)).collect()] == ["j", "k"]


@pytest.fixture()
def listing(spark):
    catalog = catalog_of(
        spark,
        ("h_bucket", "histogram_bucket", "Latency", "s", BASE),
        ("h_count", "histogram_count", "Latency", "", BASE),
        ("h_sum", "histogram_sum", "Latency", "s", BASE),
        ("s", "summary", "Sizes", "", BASE),
        ("s_count", "summary_count", "Sizes", "", BASE),
        ("s_sum", "summary_sum", "Sizes", "", BASE),
        ("new", "", "", "", BASE),
    )
    table = summary_of(
        spark,
        ("h_bucket", 0, 0, 0, 0, True),
        ("h_count", 0, 0, 2, 0, False),
        ("h_sum", 0, 0, 0, 0, False),
        ("s", 1, 0, 0, 0, False),
        ("s_count", 0, 0, 0, 0, True),
    )
    jobs = spark.createDataFrame([("s_count", "j", BASE), ("s", "j", BASE), ("h_bucket", "k", BASE)], schemas.JOB_INDEX)
    return catalog, table, jobs


def names(rows):
    return sorted(r.name for r in rows.collect())


@pytest.mark.parametrize(
    "kwargs, expected",
    [
        ({"kind": "histogram"}, ["h_bucket", "h_count", "h_sum"]),
        ({"kind": "summary"}, ["s", "s_count", "s_sum"]),
        ({"kind": ""}, ["new"]),
        ({"kind": "summary_sum"}, ["s_sum"]),
        ({"usage": "USED "}, ["h_count", "s"]),
        ({"usage": "unused"}, ["h_bucket", "s_count"]),
        ({"usage": "unused", "job": "j"}, ["s_count"]),
        ({"usage": "unused", "job": "nobody"}, []),
        ({"job": "j"}, ["s", "s_count"]),
        ({"text": "LATENCY"}, ["h_bucket", "h_count", "h_sum"]),
        ({"text": "s_", "usage": "used"}, ["s"]),  # "_" is a wildcard, and the help text says "Sizes"
        ({"usage": "odd"}, ["h_bucket", "h_count", "h_sum", "new", "s", "s_count", "s_sum"]),
    ],
)
def test_listing(listing, kwargs, expected):
    assert names(metadata.metadata_rows(*listing, **kwargs)) == expected


def test_unused_listing_is_by_name(listing):
    page = metadata.series_metadata(*listing, PageRequest(sort_by="queryCount", order="asc"), usage="unused")
    assert [r.name for r in page.data.collect()] == ["h_bucket", "s_count"]
    top = metadata.series_metadata(*listing, PageRequest(sort_by="dashboardCount"))
    assert top.data.first().name == "h_count"


def test_name_lookup_fails_open(spark, listing):
    catalog, table, jobs = listing
    rows = {r.name: r.is_unused for r in metadata.metadata_by_names(catalog, table, ["new", "h_bucket", "zzz"]).collect()}
    assert rows == {"new": False, "h_bucket": True}
    asked = spark.createDataFrame([("s",), ("s_count",), ("h_bucket",)], "name string")
    assert names(metadata.metadata_by_names(catalog, table, asked, jobs, "j")) == ["s", "s_count"]
    recomputed = {r.name: r.unused for r in metadata.metrics_unused(catalog, table, ["new", "h_sum", "s"]).collect()}
    assert recomputed == {"new": True, "h_sum": True, "s": False}
    many = ["h_bucket", "s", *(f"none_{i}" for i in range(2000))]
    assert names(metadata.metadata_by_names(catalog, table, many)) == ["h_bucket", "s"]


def test_inventory_runs_are_repeatable(spark, empty, make_log, tmp_path):
    tables = inventory.Tables(spark, str(tmp_path / "inv"))
    meta = spark.createDataFrame(
        [("up", "gauge", "Up", ""), ("lat", "histogram", "L", "s")], "name string, type string, help string, unit string"
    )
    series = spark.createDataFrame([("up", "a"), ("up", "a"), ("lat_sum", ""), ("lat_sum", "b")], "name string, job string")
    args = (empty(schemas.RULES_USAGE), empty(schemas.DASHBOARD_USAGE), make_log({"ts": BASE - DAY}))
    for day in range(2):
        report = inventory.inventory_sync(tables, *args, BASE + day * DAY, metadata=meta, series=series)
        assert report.catalog_committed and report.job_index_synced and not report.noop
    assert report.rows == {"metrics_catalog": 4, "metrics_usage_summary": 4, "metrics_job_index": 2}
    flags = {r.name: r.is_unused for r in tables.read("metrics_usage_summary").collect()}
    assert flags == {"up": False, "lat_bucket": True, "lat_count": True, "lat_sum": True}
    first = tables.read("metrics_catalog").where("name = 'up'").first()
    assert (first.first_seen_at, first.last_synced_at) == (BASE, BASE + DAY)


def test_inventory_reports_a_failed_summary(spark, empty, tmp_path):
    tables = inventory.Tables(spark, str(tmp_path / "inv"))
    names_only = spark.createDataFrame([("up",)], "name string")
    broken = spark.createDataFrame([(1,)], "nothing int")
    report = inventory.inventory_sync(
        tables, empty(schemas.RULES_USAGE), empty(schemas.DASHBOARD_USAGE), broken, BASE, names=names_only
    )
    assert report.catalog_committed and report.summary_error
    assert [r.name for r in tables.read("metrics_catalog").collect()] == ["up"]
    placeholder = tables.read("metrics_usage_summary").first()
    assert placeholder.is_unused is False
    assert tables.read("metrics_usage_summary").where(F.col("updated_at") == ntz(BASE)).count() == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    tables = inventory.Tables(spark, str(tmp_path / "inv"))
    schema = "name string, type string, help string, unit string"

    def sync(n):
        for i in range(3):
            items = spark.createDataFrame([(f"m{n}_{i}", "gauge", "h", "u")], schema)
            inventory.sync_catalog(inventory.Tables(spark, tables.root), items, BASE)

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(sync, range(3)))
    want = {f"m{n}_{i}" for n in range(3) for i in range(3)}
    snapshot = tables.snapshot()
    assert snapshot.number == 9
    for name in ("metrics_catalog", "metrics_usage_summary"):
        assert sorted(r.name for r in snapshot.read(name).collect()) == sorted(want)
    with pytest.raises(inventory.ConflictError):
        tables.publish(inventory.Snapshot(spark, 3, {}), {})
    assert tables.vacuum(dt.timedelta(days=1)) == 0
    assert tables.vacuum(dt.timedelta(0)) >= 16
    assert tables.snapshot().read("metrics_catalog").count() == 9
