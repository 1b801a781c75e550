import random
from collections import Counter

from metricledger.llm import decontam

SCHEMA = "doc_id long, text string, item_id string, similarity string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def bench_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")


def shingled(words):
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def plain_leaks(docs, items):
    """The best similarity of any window of the item's size, for all pairs that reach 0.8."""
    out = {}
    for d, text in docs:
        words = decontam.words_of(text)
        for i, item in items:
            own = decontam.words_of(item)
            want = shingled(own)
            for at in range(len(words) - len(own) + 1) if own else ():
                have = shingled(words[at : at + len(own)])
                similarity = (have & want).total() / (have | want).total()
                if similarity >= 0.8 and similarity > out.get((d, i), (0.0, 0))[0]:
                    out[d, i] = similarity, at
    return out


def sentence(rnd, n):
    return [rnd.choice(["alpha", "beta", "gamma", "delta", "eins", "zwei"]) + str(rnd.randint(0, 60)) for _ in range(n)]


def test_against_all_windows(spark):
    rnd = random.Random(1)
    items = [(i, " ".join(sentence(rnd, n))) for i, n in enumerate([3, 5, 8, 15, 30, 30, 57, 80, 300])] + [(20, None), (21, ""), (22, "..."), (None, "a b c d e f")]
    docs = []
    for d in range(60):
        words = sentence(rnd, rnd.randint(0, 60))
        _, item = items[d % 9]
        own = item.split()
        change = d // 9
        if change == 1:
            own = [w.upper() + "," for w in own]
        elif change in (2, 3) and len(own) > 20:
            for _ in range(change - 1):
                own[rnd.randrange(len(own))] = "other"
        elif change == 4:
            own = own[:-1]
        docs.append((d, " ".join([*words, *own, *sentence(rnd, 10)])))
    docs += [(100, None), (101, ""), (102, " ".join(["alpha1"] * 500)), (7, docs[7][1]), (None, items[3][1])]
    found = decontam.leaks(docs_of(spark, docs), bench_of(spark, items)).collect()
    got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found}
    want = plain_leaks(docs, [x for x in items if x[0] is not None])
    assert len(want) > 30 and any(s < 1 for s, _ in want.values())
    assert {k: v for k, v in got.items()} == want
    texts = dict(docs)
    for r in found:
        assert r.passage == texts[r.doc_id][r.start_char : r.end_char]
        assert len(decontam.words_of(r.passage)) == r.n_words


def test_blocks_of_the_benchmark_give_the_same(spark, monkeypatch):
    rnd = random.Random(2)
    items = [(i, " ".join(sentence(rnd, 12))) for i in range(9)]
    docs = [(i, "x " + items[i][1] + " y") for i in range(9)]
    whole = sorted(decontam.leaks(docs_of(spark, docs), bench_of(spark, items)).collect())
    monkeypatch.setattr(decontam, "BENCHMARK_BYTES", 300)
    assert sorted(decontam.leaks(docs_of(spark, docs), bench_of(spark, items)).collect()) == whole
    assert len(whole) == 9


def test_index_finds_everything_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    items = rng.integers(0, 256, (40, 16), dtype=np.uint8)
    sized = decontam._Sized(1, list(range(40)), [Counter()] * 40, items)
    flips = np.zeros((400, 128), np.uint8)
    for i in range(400):
        flips[i, rng.choice(128, rng.integers(0, 40), replace=False)] = 1
    prints = items[rng.integers(0, 40, 400)] ^ np.packbits(flips, axis=1)
    window, item = sized.candidates(prints)
    far = np.bitwise_count(prints[:, None] ^ items[None]).sum(2)
    assert set(zip(window.tolist(), item.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(far <= decontam.RADIUS)), strict=True))


def test_clean_rows_stay(spark):
    item = "one two three four five six seven eight"
    docs = docs_of(spark, [(1, item), (2, "clean"), (3, None), (None, "y " + item), (2, "clean")])
    left = decontam.clean(docs, bench_of(spark, [(1, item)]))
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(2, "clean"), (2, "clean"), (3, "")]
    assert decontam.clean(docs, bench_of(spark, [])).count() == 5
    assert decontam.leaks(docs_of(spark, []), bench_of(spark, [(1, item)])).count() == 0
