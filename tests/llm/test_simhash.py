import random
from collections import defaultdict
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from metricledger.llm import simhash
from metricledger.llm.components import stars

SCHEMA = "doc_id long, text string, fingerprint string, component_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints):
    """Smallest label by label, over all pairs."""
    parent = {f: f for f in fingerprints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 3:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in parent}


def test_fingerprints():
    rnd = random.Random(3)
    texts = [None, "", " \n\x0b", "One", "one TWO", "a\tb  c", "Äx b c d", "\x1c x \x85 y z"]
    texts += [" ".join(rnd.choice(["the", "Größe", "x", "Ä"]) for _ in range(n)) for n in (5, 40, 300, 1_000)]
    for text in texts:
        got = simhash.fingerprint(None if text is None else text.encode())
        assert got & 0xFFFFFFFFFFFFFFFF == plain_fingerprint(text)


def near_fingerprints(seed, centres=12, copies=25):
    rnd = random.Random(seed)
    out = set()
    for _ in range(centres):
        f = rnd.getrandbits(64)
        for _ in range(copies):
            g = f
            for b in rnd.sample(range(64), rnd.randint(0, 5)):
                g ^= 1 << b
            out.add(g)
    return sorted(out | {0, 1, 7, 15, 1 << 63})


@pytest.mark.parametrize("crowded", [1_024, 6, 2])
def test_links_connect_what_all_pairs_connect(spark, crowded):
    signed = [f - (1 << 64) if f >> 63 else f for f in near_fingerprints(crowded)]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(nodes, crowded).cache()
    assert all(((r.u ^ r.v) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 3 and r.u > r.v for r in edges.collect())
    found = {f: f for f in signed} | {r.node: r.root for r in stars(edges).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for f, r in found.items():
        groups[r].add(f & 0xFFFFFFFFFFFFFFFF)
    for f, r in plain_components(near_fingerprints(crowded)).items():
        want[r].add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_forest_of_many_members():
    members = near_fingerprints(9)
    edges = simhash.forest([f - (1 << 64) if f >> 63 else f for f in members])
    assert len(edges) == len(members) - len(set(plain_components(members).values()))


def test_components_and_kept_rows(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, long), (3, long), (9, long.upper()), (4, "some other text altogether"), (4, "some other text altogether"), (7, None), (8, ""), (None, "no id at all"), (None, long)]
    docs = docs_of(spark, rows)
    got = sorted(((r.doc_id or 0), r.component_id or 0) for r in simhash.components(docs).collect())
    assert got == [(0, 0), (0, 3), (3, 3), (4, 4), (4, 4), (5, 3), (7, 7), (8, 7), (9, 3)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "no id at all"), (3, long), (4, "some other text altogether"), (7, "")]


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    assert {(r.root) for r in stars(edges).collect()} == {0}


def test_empty_table(spark):
    assert simhash.components(docs_of(spark, [])).count() == 0
    assert simhash.keep_one(docs_of(spark, [])).count() == 0


def test_op7_against_all_pairs(spark, sf):
    from metricledger.llm.queries import QUERIES

    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op7_deletion_simhash"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = plain_components(sorted(set(prints.values())))
    names = {}
    for i, f in prints.items():
        names[root[f]] = min(i, names.get(root[f], i))
    assert got == {i: (f"{f:016x}", names[root[f]]) for i, f in prints.items()}
