import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from metricledger.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def least_capacity(sizes, shards):
    def feasible(capacity):
        used, filled = 1, 0
        for s in sizes:
            if s > capacity:
                return False
            if filled + s > capacity:
                used, filled = used + 1, 0
            filled += s
        return used <= shards

    return next(c for c in range(1, sum(sizes) + 1) if feasible(c))


@pytest.mark.parametrize("seed, hot", [(1, False), (2, True), (3, True)])
def test_optimal_contiguous_and_whole(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 16)
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rnd = random.Random(seed)
    rows = [(i, "ä" * rnd.randint(0, 60) if i % 9 else None) for i in range(200)] + [(5, "x"), (5, "x"), (None, "y")]
    if hot:
        rows += [(1_000 + i, "a third of all rows") for i in range(100)]
    got = sharding.assign(docs_of(spark, rows), 5).collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((i or -1) for i, _ in rows)
    groups, where = defaultdict(int), {}
    for r in got:
        groups[r.digest] += r["size"]
        assert where.setdefault(r.digest, r.shard) == r.shard
    order = sorted(groups)
    assert [where[d] for d in order] == sorted(where[d] for d in order)
    held = defaultdict(int)
    for d in order:
        held[where[d]] += groups[d]
    assert max(held.values()) == least_capacity([groups[d] for d in order], 5)
    for s in range(5):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_sizes_and_checksums(spark):
    got = {r.doc_id: r for r in sharding.assign(docs_of(spark, [(1, "hé"), (2, ""), (3, None)]), 2).collect()}
    assert (got[1]["size"], got[1].text_crc32) == (4, zlib.crc32("hé".encode()))
    assert got[1].digest == hashlib.md5("hé".encode()).hexdigest()
    assert (got[2]["size"], got[2].text_crc32, got[3]["size"], got[3].text_crc32) == (1, 0, 1, 0)
    assert got[2].digest != got[3].digest


def test_empty_table(spark):
    assert sharding.assign(docs_of(spark, []), 4).count() == 0


def test_search_splits_only_cut_cells():
    cells = [sharding.Cell(f"{i:x}", 3, 10) for i in range(16)]
    capacity, starts, inside = sharding._smallest(cells, 3)
    assert capacity == 54 and len(inside) <= 2 and not starts


def test_plan_is_native(spark):
    plan = sharding.assign(docs_of(spark, [(1, "a"), (2, "b")]), 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_written_shards(spark, tmp_path):
    docs = docs_of(spark, [(i, f"text {i % 7}") for i in range(50)]).drop("shard")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50
    assert back.groupBy("text").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
