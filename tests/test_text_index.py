import random

import pytest

from metricledger import schemas
from metricledger.operators.filters import ilike_any
from metricledger.sources import text_index
from metricledger.sources.text_index import TextIndex, grams_of_pattern
from tests.conftest import BASE, plan_of


def rows_of(spark, rows):
    return spark.createDataFrame([(n, "gauge", h, "", BASE, BASE) for n, h in rows], schemas.METRICS_CATALOG)


def some_rows(seed, n=400):
    rnd = random.Random(seed)
    parts = ["http", "Requests", "total", "ns", "a_b", "100%", "Größe", "日本語", "\\x", "node", "CPU", ""]
    rows = [(f"m{i}_" + "_".join(rnd.choices(parts, k=rnd.randint(0, 4))), rnd.choice([None, "", " ".join(rnd.choices(parts, k=3))])) for i in range(n)]
    return rows + [("ab", "x"), ("x", None), ("Ωσς", "ΟΔΟΣ")]


PATTERNS = ["", "a", "ht", "http", "REQUESTS", "s_t", "htt%tot", "100\\%", "_____", "%%", "größe", "n\\_", "m1%node", "本語", "nothing here", "\\\\x", "σς", "de_cpu", "p%q_"]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    catalog = rows_of(spark, some_rows(1))
    return catalog, TextIndex(spark, str(tmp_path_factory.mktemp("index") / "i")).build(catalog)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_equals_the_scan(indexed, pattern):
    catalog, index = indexed
    for fields in (["name"], ["name", "help"]):
        want = sorted(r.name for r in ilike_any(catalog, fields, pattern).collect())
        assert sorted(r.name for r in index.search(pattern, fields).collect()) == want


def test_grams_of_patterns():
    assert grams_of_pattern("Abcd") == ["abc", "bcd"]
    assert grams_of_pattern("ab%cd_efg") == ["efg"]
    assert grams_of_pattern("a\\%b") == ["a%b"]
    assert grams_of_pattern("aßbc") == [] == grams_of_pattern("ab")


def test_updates(spark, tmp_path):
    rows = dict(some_rows(2))
    index = TextIndex(spark, str(tmp_path / "i")).build(rows_of(spark, rows.items()))
    for step in range(2):
        changed = {name: f"now {step} requests" for name in list(rows)[step::7]} | {f"new_{step}_http": None}
        rows |= changed
        index.update(rows_of(spark, changed.items()))
        catalog = rows_of(spark, rows.items())
        assert sorted(map(tuple, index.search("").collect())) == sorted(map(tuple, catalog.collect()))
        for pattern in ("http", f"now {step}", "requests", "largest", "größe"):
            want = sorted(r.name for r in ilike_any(catalog, ["name", "help"], pattern).collect())
            assert sorted(r.name for r in index.search(pattern).collect()) == want


def test_plan_reads_folders_of_the_grams_and_of_what_they_find(indexed):
    _, index = indexed
    plan = plan_of(index.search("requests"))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "Initial" not in line]
    postings = next(line for line in scans if "gram" in line)
    assert "In(gram" in postings and "part#" in postings.split("PartitionFilters")[1].split("PushedFilters")[0]
    catalog = next(line for line in scans if "help" in line)
    assert "dynamicpruning" in catalog.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_most_grams_only_narrow(indexed, monkeypatch):
    catalog, index = indexed
    monkeypatch.setattr(text_index, "MOST_GRAMS", 1)
    assert index.search("requests_total").count() == ilike_any(catalog, ["name", "help"], "requests_total").count()
