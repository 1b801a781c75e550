"""Stages over documents that are computed, not read: they drop the same rows as over the file."""

from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from metricledger.llm import decontam, packing, simhash, toxicity
from metricledger.llm.common import table

FORMS = {
    "grouped": lambda d: d.groupBy("doc_id").agg(*(F.first(c).alias(c) for c in d.columns if c != "doc_id")).select(d.columns),
    "shuffled": lambda d: d.repartition(7, F.xxhash64("text")),
    "joined": lambda d: d.join(d.select("doc_id").hint("shuffle_hash"), "doc_id").select(d.columns),
}
STAGES = {
    "clean": lambda d, spark, sf: decontam.clean(d, table(spark, sf, "benchmark")),
    "keep_one": lambda d, spark, sf: simhash.keep_one(d),
    "keep_clean": lambda d, spark, sf: toxicity.keep_clean(d, table(spark, sf, "labels")),
}


@pytest.mark.parametrize("stage", STAGES)
def test_same_rows_stay(spark, sf, stage):
    if stage == "keep_clean":  # the smallest table has no document that the model rejects
        sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    want = Counter(map(tuple, STAGES[stage](docs, spark, sf).collect()))
    assert 0 < want.total() < docs.count()
    for form in FORMS.values():
        left = STAGES[stage](form(docs), spark, sf)
        assert left.columns == docs.columns
        assert Counter(map(tuple, left.collect())) == want


def test_sequences_of_computed_documents(spark, sf):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = FORMS["grouped"](table(spark, sf, "documents"))
    packed, sequences = packing.packed_sequences(docs, path)
    ids = {r.sequence_id: bytes(r.ids) for r in sequences.collect()}
    parts = {}
    for r in packed.collect():
        parts.setdefault(r.doc_id, {})[r.piece] = ids[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]
    tokenizer = Tokenizer.from_file(path)
    for r in docs.collect():
        want = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        assert b"".join(parts[r.doc_id][i] for i in sorted(parts[r.doc_id])) == b"".join(i.to_bytes(4, "little") for i in want)
