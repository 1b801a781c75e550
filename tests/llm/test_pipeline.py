"""The registered queries and the stages of the pipeline on the given tables."""

import re
import zlib

import pytest

import corpus_pipeline
from metricledger.llm import decontam, simhash, substring
from metricledger.llm.common import written
from metricledger.llm.queries import QUERIES, TWINS
from tests.compare import difference, duck


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twins(spark, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck(sf).execute(TWINS[name]).df()
    for c in got.columns:
        if got[c].dtype.kind == "f":
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert difference(got, want) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_one_row_a_document(spark, sf, name):
    got = QUERIES[name](spark, sf)
    ids = sorted(r.doc_id for r in got.select("doc_id").collect())
    docs = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect())
    if name.split("_")[0] in ("op2", "op3", "op4"):
        assert set(ids) <= set(docs) and ids
    else:
        assert ids == docs


def test_held_out_rows(spark, sf):
    for r in QUERIES["op5_additive_quality"](spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, frames = [n for n, _ in corpus_pipeline.STAGES], [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(written(stage(spark, frames[-1], sf), name))
    assert names == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "packing"]
    assert all(f.schema == docs.schema for f in frames[:-1])
    _, clean, single, cut, kept, packed = [{r.doc_id: r for r in f.collect()} for f in frames]
    # near-duplicates: the smallest of each component stays
    found = {r.doc_id: r.component_id for r in simhash.components(frames[1]).collect()}
    assert set(single) == set(found.values()) and set(found) == set(clean)
    # repeats: what is left holds no passage that an earlier document holds, and nothing else went
    assert set(cut) <= set(single)
    for i, r in cut.items():
        assert r.n_chars == len(r.text) or r.text == single[i].text
    assert substring.repeats(frames[3]).count() <= substring.repeats(frames[2]).count() // 10
    # leaks: documents that hold an item go, all others stay
    items = [decontam.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = [" " + " ".join(w) + " " for w in items]
    for i, r in cut.items():
        text = " " + " ".join(decontam.words_of(r.text)) + " "
        if any(w in text for w in whole):
            assert i not in kept
    dirty = {r.doc_id for r in decontam.leaks(frames[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert set(kept) == set(cut) - dirty
    assert set(packed) == set(kept)


def test_run_equals_the_stages(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() >= 100


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for path in [*root.glob("metricledger/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert not re.search(r"metricledger\.llm|corpus_pipeline", path.read_text()), path
