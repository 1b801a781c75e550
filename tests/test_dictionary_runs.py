import pytest
from hypothesis import given
from hypothesis import strategies as st

from metricledger.operators import enrich
from metricledger.sources import folders
from metricledger.sources.dictionary_runs import DictionaryRuns, merges_at, runs_before


@given(st.integers(0, 5_000), st.integers(2, 17))
def test_runs_cover_the_batches_before(batch, width):
    runs = runs_before(batch, width)
    covered = [b for level, run in runs for b in range(run * width**level, (run + 1) * width**level)]
    assert covered == list(range(batch))
    levels = max([level for level, _ in runs], default=0) + 1
    assert len(runs) <= (width - 1) * levels


@pytest.mark.parametrize("width", [2, 3])
def test_a_run_is_there_when_it_is_read(width):
    """Merges write what later batches read, and need only what is still there, also when a batch is repeated."""
    there = set()
    for batch in range(100):
        for _ in range(2):
            for level, run in merges_at(batch, width):
                inner = {(level - 1, run * width + i) for i in range(width)}
                assert inner <= there
                there.add((level, run))
            for level, run in merges_at(batch - 1, width):
                there -= {(level - 1, run * width + i) for i in range(width)}
            assert set(runs_before(batch, width)) <= there
            there.add((0, batch))


def test_dictionary_over_many_batches(spark, tmp_path):
    """Every batch repeats texts of others, some batches run twice; in the end each text is there once, and few runs are left."""
    store = DictionaryRuns(spark, str(tmp_path / "words"), width=2, parts=4)
    described = []
    for batch in range(7):
        log = spark.createDataFrame([(f"m_{batch // 2}",), (f"m_{batch}",), (None,)], "query_param string")
        for attempt in range(2 if batch in (0, 2, 4) else 1):
            store.settle(batch)
            found = store.known(enrich.distinct_texts(log), batch).persist()
            fresh = [r.query_param for r in store.add(enrich.expression_dictionary(found.where("part IS NULL")), batch).collect()]
            assert found.count() == len({batch // 2, batch}) + 1
            found.unpersist()
        described += fresh
    assert sorted(described) == sorted(["", *(f"m_{i}" for i in range(7))])
    rows = store.all(7).collect()
    assert sorted(r.query_param for r in rows) == sorted(described)
    assert all(r.fingerprint for r in rows if r.query_param)
    left = [(level, run) for level in range(4) for run in range(8) if folders.exists(spark, store._path(level, run))]
    assert left == [(0, 4), (0, 5), (0, 6), (1, 2), (2, 0)]  # the first two go with the next batch


def test_few_texts_read_few_folders(spark, tmp_path):
    store = DictionaryRuns(spark, str(tmp_path / "words"), width=2, parts=16)
    for batch in range(3):
        store.settle(batch)
        log = spark.createDataFrame([(f"m_{batch}_{i}",) for i in range(50)], "query_param string")
        store.add(enrich.expression_dictionary(log), batch)
    asked = store.known(spark.createDataFrame([("m_0_7",)], "query_param string"), 2)
    assert asked.first().metric_names == ["m_0_7"]
    assert len(asked.inputFiles()) <= 16 and "PartitionFilters: [part" in asked._jdf.queryExecution().executedPlan().toString().replace("isnotnull(part", "part")
