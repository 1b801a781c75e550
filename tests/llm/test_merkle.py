import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from metricledger.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf string, pos long, root string"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", 5, "clash") for r in rows], SCHEMA)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, at):
    """Siblings from the bottom to the top: (sibling or None, whether it stands left)."""
    out = []
    for level in levels[:-1]:
        out.append((level[at ^ 1] if at ^ 1 < len(level) else None, at % 2 == 1))
        at //= 2
    return out


def plain(rows):
    """Rows (doc_id, text, lang, source, n_chars) one after the other."""
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {lang: tree_of([leaf for *_, leaf, _ in sorted(by_lang[lang], key=lambda k: k[:3])]) for lang in langs}
    top = tree_of([trees[lang][-1][0] for lang in langs])
    out = []
    for i, lang in enumerate(langs):
        for at, (*_, leaf, r) in enumerate(sorted(by_lang[lang], key=lambda k: k[:3])):
            seen = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                seen = leaf_of(*r[:4], r[4] + 1)
            siblings = path(trees[lang], at) + path(top, i)
            for sibling, left in siblings:
                seen = digest(seen if sibling is None else sibling + seen if left else seen + sibling)
            proof = digest("".join(s for s, _ in siblings if s is not None))
            out.append((r[0], leaf, trees[lang][-1][0], top[-1][0], proof, seen, seen == top[-1][0]))
    return out


def compare(spark, rows):
    got = [tuple(r) for r in merkle.verify(docs_of(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    return got


@pytest.mark.parametrize("sizes", [[1], [2], [3, 1], [5, 4, 1, 2, 7], [256, 255, 257], [1_500, 1]])
def test_trees_of_many_sizes(spark, sizes):
    rows = [(100 * i + j * 3, f"text {j}", f"l{i}", "src", j) for i, n in enumerate(sizes) for j in range(n)]
    got = compare(spark, rows)
    assert all(r[6] != (zlib.crc32(str(r[0]).encode()) % 7 == 0) for r in got)


def test_more_languages_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(merkle, "SENT_NODES", 0)
    compare(spark, [(i, "t", f"l{i // 2}", None, i) for i in range(700)])


def test_odd_rows(spark):
    rows = [(7, "ä\n", "de", "s", 2)] * 3 + [(None, None, None, None, None)] * 2 + [(1, "", None, "", 0), (1, "x" * 300_000, "", "s", 9), (2, "-", "", "-", None), (None, "t", "de", "s", 3)]
    rows += [(3, "t", "de", "s", 2**63 - 1), (-4, "t", "de", "s", -1), (3, "u", "de", "s", 4)]
    compare(spark, rows)


def test_empty_table(spark):
    assert merkle.verify(docs_of(spark, [])).count() == 0


def test_limit_is_put_back(spark):
    before = spark.conf.get(merkle.ROW_LIMIT)
    compare(spark, [(i, "t", "x", "s", 1) for i in range(9)])
    assert spark.conf.get(merkle.ROW_LIMIT) == before


def test_a_large_language_lies_in_many_partitions(spark):
    rows = spark.range(5_000).select(F.col("id").alias("k"), F.lit("en").alias("lang"))
    placed = merkle.in_order(rows, "lang", ["k"])
    assert placed.where("pos <> k OR n <> 5000").count() == 0
