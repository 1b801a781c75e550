import random
import re

import numpy as np
import pytest

from metricledger.llm import minhash

SCHEMA = "doc_id long, text string, component_id string, node string, signature string, root string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash", "clash") for i, t in rows], SCHEMA)


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    """(doc_id, set size, smallest doc_id of the component) over all pairs; rows without a doc_id are left to the caller."""
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    names = {}
    for i, (doc, _) in enumerate(rows):
        names[root(i)] = min(doc, names.get(root(i), doc))
    return sorted((d, len(s), names[root(i)] if s else d, d == (names[root(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def near_copies(seed, groups=12, copies=14):
    rnd = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [rnd.choice("abcdefgh") + str(rnd.randint(0, 200)) for _ in range(rnd.choice([3, 5, 9, 60, 200, 400]))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9])):
                own[rnd.randrange(len(own))] = "x" + str(rnd.randint(0, 9))
            rows.append((len(rows) * 3 % 1_009, " ".join(own)))
    return rows


@pytest.mark.parametrize("block", [512, 8, 3])
def test_against_all_pairs(spark, block):
    rows = near_copies(block)
    got = minhash.components(docs_of(spark, rows), block)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, long), (3, long.upper()), (9, long + " end"), (4, None), (6, ""), (7, " \n\x0b"), (8, "Ä b"), (2, "Ä\tB"), (1, "ä b"), (8, "Ä b"), (10, "a b c d e"), (11, "e d c b a")]
    want = plain(rows)
    nulls = [(None, long + " "), (None, "nobody else has this text"), (None, "nobody else has this text"), (None, None)]
    got = [tuple(r) for r in minhash.components(docs_of(spark, rows + nulls)).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    assert sorted((n, c or -1, k) for d, n, c, k in got if d is None) == [(0, -1, False), (1, -1, False), (1, -1, False), (59_996, 3, False)]


def test_empty_table(spark):
    assert minhash.components(docs_of(spark, [])).count() == 0


def test_signatures_within_the_threshold_meet():
    rnd = np.random.default_rng(1)
    for far in (0, 1, 12, 23):
        one = rnd.integers(0, 1 << 16, (200, minhash.PLACES)).astype("<u2")
        other = one.copy()
        for row in other:
            row[rnd.permutation(minhash.PLACES)[:far]] += 1
        assert ((minhash.keys(one) == minhash.keys(other)).sum(1) > 0).all()


def test_signatures_tell_the_similarity():
    rnd = random.Random(4)
    for share in (0.5, 0.85, 0.95):
        far = []
        for _ in range(60):
            both = [rnd.getrandbits(64) for _ in range(int(600 * share))]
            one, other = ([rnd.getrandbits(64) for _ in range((600 - len(both)) // 2)] for _ in range(2))
            a, b = (minhash.signature(np.unique(np.array(both + x, np.uint64))) for x in (one, other))
            far.append((a != b).mean())
        assert abs(np.mean(far) - (1 - share)) < 0.02


def test_op13_against_all_pairs(spark, sf):
    from metricledger.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_hamming_minhash"](spark, sf).collect()) == plain(rows)
