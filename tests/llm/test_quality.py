import random
import zlib

import numpy as np
import pytest

from metricledger.llm import quality

DOCS = "doc_id long, text string, score string, quality string"
LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice(["en", "an", "the", "er", "on"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 80))]
        kind = i % 5
        if kind == 0:
            words = [w + "&&&" for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind > 1), 0))
    return docs, labels


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    return docs, labels, quality.fit(docs_of(spark, docs), labels_of(spark, labels))


def test_held_out_documents(spark, fitted):
    docs, labels, model = fitted
    want = {i: q for i, q, _ in labels}
    got = {r.doc_id: r.score for r in quality.score(docs_of(spark, docs), model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean([(got[i] >= 0.3) == want[i] for i in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values())


def test_held_out_labels_are_never_used(spark, fitted):
    docs, labels, model = fitted
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    other = quality.fit(docs_of(spark, docs), labels_of(spark, turned))
    assert all((a.values == b.values).all() for a, b in zip(other.tables, model.tables, strict=True))


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(4)
    x = rng.random((4_000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in [t.of for t in model.tables]
    assert ((model.scores(x) > 0.5) == y).mean() > 0.9
    model.tables = [t for t in model.tables if len(t.of) == 1]
    assert ((model.scores(x) > 0.5) == y).mean() < 0.7


def test_scores_are_sums_of_tables(fitted):
    model = fitted[2]
    x = np.array([quality.features(t.encode()) for _, t in fitted[0][:20]])
    for row, z in zip(x, model.logits(x), strict=True):
        total = model.base
        for t in model.tables:
            at = 0
            for f, edges in zip(t.of, t.edges, strict=True):
                at = at * (len(edges) + 1) + sum(row[f] >= e for e in edges)
            total += t.values[at]
        assert abs(total - z) < 1e-9


def test_odd_rows(spark, fitted):
    rows = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "the"), (4, "en " * 50_000)]
    got = {}
    for r in quality.score(docs_of(spark, rows), fitted[2]).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert got[1] == got[2] and len(got[3]) == 2 and len(set(got[3])) == 1 and set(got) == {1, 2, 3, 4, None}
    assert quality.score(docs_of(spark, []), fitted[2]).count() == 0


def test_few_labels(spark):
    docs = docs_of(spark, corpus(10)[0])
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels_of(spark, []))).collect()} == {0.5}
    one_kind = labels_of(spark, [(i, 1, 0) for i in range(10)] + [(3, 0, 0), (4, None, 0)])
    assert all(r.score > 0.8 for r in quality.score(docs, quality.fit(docs, one_kind)).collect())
