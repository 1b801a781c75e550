import pyarrow as pa

from metricledger.llm import common


def test_memory_is_handed_back_after_the_last_batch(monkeypatch):
    """The same batches, in order; memory is handed back once, after the last of them."""
    said = []
    monkeypatch.setattr(common, "_trim", lambda: said.append)
    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    run = common.handed_back(lambda given: (said.append(b) or b for b in given))
    assert list(run(iter(batches))) == batches
    assert said == [*batches, 0]
    assert list(run(iter([]))) == []


def test_the_systems_allocator_is_asked():
    assert common._trim() is None or common._trim()(0) in (0, 1)
