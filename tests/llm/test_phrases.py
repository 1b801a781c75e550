import random
import re
from collections import Counter, defaultdict

import pytest

from metricledger.llm import phrases

SCHEMA = "doc_id long, text string, lang string, words string, n string, phrase string, hash string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash", "clash", "clash") for i, t, lang in rows], SCHEMA)


def plain_counts(rows):
    found, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3, 4):
                for i in range(len(words) - k + 1):
                    found[lang, tuple(words[i : i + k])] += 1
    return found, n


def plain(rows, support, best=2_000):
    found, n = plain_counts(rows)
    candidates = {k: f for k, f in found.items() if len(k[1]) > 1 and f >= support}
    inside = defaultdict(int)
    for (lang, words), f in candidates.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inside[lang, words[i : i + k]] = max(f, inside[lang, words[i : i + k]])
    by_lang = defaultdict(list)
    for (lang, words), a in candidates.items():
        if 100 * inside[lang, words] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = found[lang, words[:k]], found[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang[lang].append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, ranked in by_lang.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, docs=250):
    rnd = random.Random(seed)
    words = ["a", "b", "Größe", "größe", "the", "THE", "x\x00", "é", "日本", *(f"w{i}" for i in range(8))]
    rows = []
    for i in range(docs):
        text = "".join(rnd.choice(words) + rnd.choices([" ", "\t ", ". ", ",", "\n", "\r", "; x"], [14, 2, 1, 1, 1, 1, 1])[0] for _ in range(rnd.randint(0, 60)))
        rows.append((i, text + "New York City Hall " * (i % 3), rnd.choice(["en", "de", None, "und"])))
    rows += [(1, None, "en"), (2, "", None), (3, ".,;!", "fr"), (None, "the the the the", "en"), (4, "one two " * 3_000, "en")] + [(5, "to be or not to be", "en")] * 40
    return rows


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_against_all_runs(spark, share):
    """With no sample every level is a border failure; with all documents in it none is."""
    rows = corpus(int(share * 10))
    got = phrases.collocations(docs_of(spark, rows).repartition(5), support=12, share=share)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, 12)
    assert len(want) > 100
    assert sorted(tuple(r) for r in got.collect()) == want


def test_best_of_each_language(spark):
    rows = corpus(5)
    assert sorted(tuple(r) for r in phrases.collocations(docs_of(spark, rows), support=12, best=7).collect()) == plain(rows, 12, 7)


def all_proposed():
    return phrases.Proposals(phrases.np.full(phrases.CELLS // 8, 255, phrases.np.uint8))


def test_windows_of_a_long_text(monkeypatch):
    monkeypatch.setattr(phrases, "_WINDOW", 50)
    monkeypatch.setattr(phrases, "LOAD", 40)
    rows = [(0, t, lang) for _, t, lang in corpus(8, 20) if t] + [(0, "long" * 100 + " a b" * 100 + ". c d", "en")]
    found, load, now = Counter(), phrases._Load(), all_proposed()

    def take():
        for level in load.levels(4, now):
            for b in level.by_words():
                for r in b.to_pylist():
                    found[r["lang"], tuple(r["phrase"].split(" "))] += r["f"]

    for _, text, lang in rows:
        for _ in load.add(lang or "und", text.encode()):
            take()
            load.clear()
    take()
    assert found == plain_counts(rows)[0]


def test_closing_pass_takes_up_what_was_not_admitted():
    load, full, none = phrases._Load(), all_proposed(), phrases.Proposals()
    for _ in load.add("en", b"a b c d e a b c"):
        pass

    def runs(now, before=None):
        return {r["phrase"]: r["f"] for level in load.levels(4, now, before) for b in level.by_words() for r in b.to_pylist()}

    assert runs(none, none) == {}  # words were counted, and are not marked
    assert runs(full, none) == runs(full) and runs(full)["a b c"] == 2
    assert runs(full, full) == runs(full)
    assert load.totals().to_pylist() == [{"lang": "en", "words": 0, "phrase": "", "f": 8}]


def test_empty_table(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [(1, None, None)])).count() == 0
