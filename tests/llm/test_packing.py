import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from metricledger.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizer(tokenizer):
    rnd, ids = random.Random(5), packing.Ids(PATH)
    letters = "aabbeeinnostrthlöäüéèßñÀÇ.,!'<|>0129½ \n\t\x1c\u0301 ΣσİıŒ中ªµ"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(4_000)]
    texts += ["<|endoftext|>x", "don't we'll 's", "a" * 300, "ab" * 200, "", " ", "Wörter, die enden. (so)"]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids(text), "<u4").tolist() == want.ids


def test_forgets_words_without_harm(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 3)
    ids = packing.Ids(PATH)
    for text in ("one two three four five", "", "two six  one\n\nseven"):
        assert np.frombuffer(ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_and_are_few(seed):
    rnd = np.random.default_rng(seed)
    sizes = rnd.integers(1, 100, 150)
    of = packing.pack_sizes(sizes, 100)
    fills = np.bincount(of, sizes)
    assert fills.max() <= 100 and (fills > 0).all()
    assert len(fills) <= packing._Bins(sizes, 100).room.size
    assert len(fills) <= -(-sizes.sum() // 100) + 1 + (sizes > 50).sum() // 10


@pytest.mark.parametrize("bins", [[[6, 4], [5, 4], [1]], [[7, 2], [6, 2], [3]], [[5, 2, 2], [4, 2], [5]], [[6, 3], [5, 4], [2]]])
def test_search_empties_a_bin(bins):
    """Fillings in which no piece fits anywhere as it is, but exchanges make room (or the pieces need as many bins)."""
    sizes = np.array([s for b in bins for s in b])
    state = packing._Bins(sizes, 10)
    state.of = np.array([i for i, b in enumerate(bins) for _ in b])
    state.room = np.array([10 - sum(b) for b in bins])
    state.search()
    fills = np.bincount(state.of, sizes, len(bins))
    assert fills.max() <= 10 and fills.sum() == sizes.sum()
    assert (fills > 0).sum() == -(-sizes.sum() // 10)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, sequence_id string")


def test_pack_documents(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 12)
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["the", "word", "größe", "x!"]) for _ in range(rnd.randint(0, 70)))) for i in range(60)]
    rows += [(7, "twice"), (7, "twice"), (100, None), (101, ""), (102, "long " * 200), (None, "no id")]
    docs = docs_of(spark, rows)
    got = packing.pack_documents(docs, PATH, 32).collect()
    want = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 32):
            part = np.array(ids[k : k + 32], "<u4").tobytes()
            want.append((-1 if i is None else i, k // 32, k, len(part) // 4, zlib.crc32(part)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 32
    assert len(held) <= 1.05 * sum(w[3] for w in want) / 32 + 2


def test_sequences_hold_the_ids(spark):
    docs = docs_of(spark, [(1, "a b c"), (2, "größe " * 20), (3, None)])
    pieces = packing.tokenize(docs, PATH, 16).cache()
    from pyspark.sql import functions as F

    packed = packing.pack(pieces.select("doc_id", "row", "piece", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32")), 16)
    total = sum(len(r.ids) for r in packing.sequences(pieces, packed).collect())
    assert total == sum(len(r.ids) for r in pieces.collect())
    pieces.unpersist()


def test_empty_table(spark):
    assert packing.pack_documents(docs_of(spark, []), PATH).count() == 0
