import math
import random
import zlib

import numpy as np
import pytest

from metricledger.llm import toxicity

DOCS = "doc_id long, text string, score string, toxic string"
LABELS = "doc_id long, quality int, toxic int, text string"
BAD = ["idiot", "moron", "scum", "stupid", "worthless"]


def corpus(n=400, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rnd.choice(["en", "an", "the", "er", "on", "ti", "sh"]) for _ in range(rnd.randint(1, 3))) for _ in range(rnd.randint(5, 60))]
        toxic = int(i % 5 == 0)
        if toxic:
            for _ in range(2):
                words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    model = toxicity.fit(docs_of(spark, docs), labels_of(spark, labels))
    return docs, labels, model


def test_character_model_counts_all_texts(spark):
    model = toxicity.character_model(docs_of(spark, [(1, "ab ab"), (2, "AB, c"), (3, None), (4, "")]))
    assert np.allclose(np.exp(model).sum(2), 1, atol=1e-4)
    a, b, c = 1, 2, 3
    p1 = lambda n: (n + 1) / (uni + 64)
    uni = 3 + 3 + 1 + 4  # a, b, c and the boundaries after words
    # after a word's first a (three times), b follows always
    bi = (3 + 5 * p1(3)) / (3 + 5)
    assert math.isclose(np.exp(model[0, a, b]), (3 + 5 * bi) / (3 + 5), rel_tol=1e-3)
    assert model[0, a, b] > model[0, a, c]


def test_viterbi_is_the_cheapest_of_all_paths(fitted):
    decoder = toxicity.Decoder(fitted[2].characters)

    def readings(token):
        """Every path and its price, without dynamic programming."""
        out = [(0.0, "")]
        for i, ch in enumerate(token):
            again = i > 0 and token[i - 1] == ch and (token[i - 2 : i + 1] == 3 * ch or token[i - 1 : i + 2] == 3 * ch)
            reads = [(x, toxicity.LOOK_ALIKE) for x in toxicity.LOOKS.get(ch, "")] + ([(ch, 0.0)] if ch.isalpha() else [])
            drop = toxicity.DROPPED if ch in toxicity.SEPARATORS or not reads else toxicity.REPEATED if again else None
            more = [(p + drop, t) for p, t in out] if drop is not None else []
            for p, t in out:
                for x, price in reads:
                    a, b = ([0, 0] + [toxicity._symbol(y) for y in t])[-2:]
                    more.append((p + price + decoder.model[a][b][toxicity._symbol(x)], t + x))
            out = more
        def ended(p, t):
            a, b = ([0, 0] + [toxicity._symbol(y) for y in t])[-2:]
            return p + (decoder.model[a][b][0] if b else 0.0)
        return max(ended(p, t) for p, t in out), {t: ended(p, t) for p, t in sorted(out)}

    for token in ["1d10t", "m0r0n", "$cum", "s.t.u.p.1.d", "stuuupid", "w0rth1ess", "1|!1", "x-1"]:
        best, prices = readings(token)
        assert math.isclose(prices[decoder.viterbi(token)], best, abs_tol=1e-6)


def test_disguised_words_are_restored(fitted):
    _, _, model = fitted
    decoder, scorer = toxicity.Decoder(model.characters), model.scorer()
    for disguised, plain in [("1d10t", "idiot"), ("m0r0n!!", "moron"), ("$cum", "scum"), ("s-t-u-p-i-d", "stupid"), ("stuuuupid", "stupid"), ("m.o.r.o.n", "moron")]:
        assert plain in decoder.words(disguised)
        assert scorer.score(f"the en {disguised} anen the {disguised}") >= 0.5
    assert scorer.score("the en m o r o n the en i d i 0 t") >= 0.5
    assert toxicity.restored("The M0R0N anen!", decoder).split() [:2] == ["the", "moron"]
    assert scorer.score("the en anen the shon titi") < 0.5


def test_held_out_documents(spark, fitted):
    docs, labels, model = fitted
    toxic = {i: t for i, _, t in labels}
    got = {r.doc_id: r.score for r in toxicity.score(docs_of(spark, docs), model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and all((got[i] >= 0.5) == toxic[i] for i in held)


def test_held_out_labels_are_never_used(spark, fitted):
    docs, labels, model = fitted
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    other = toxicity.fit(docs_of(spark, docs), labels_of(spark, turned))
    assert other.weights == model.weights and other.coefficients == model.coefficients


def test_odd_rows(spark, fitted):
    _, _, model = fitted
    rows = [(1, None), (2, ""), (3, "idiot moron scum"), (3, "idiot moron scum"), (None, "the"), (4, "x " * 50_000 + "idiot moron")]
    got = {}
    for r in toxicity.score(docs_of(spark, rows), model).collect():
        got.setdefault(r.doc_id, []).append(r.score)
    assert got[1] == got[2] and got[1][0] < 0.5 and len(set(got[3])) == 1 and got[3][0] >= 0.5
    assert toxicity.score(docs_of(spark, []), model).count() == 0


def test_without_labels(spark):
    docs, _ = corpus(20)
    labels = [(1, 1, None), (None, 1, 1), (2, 1, 0), (2, 1, 1), (99, 1, 1)]
    model = toxicity.fit(docs_of(spark, docs), labels_of(spark, labels))
    assert {r.score < 1e-9 for r in toxicity.score(docs_of(spark, docs), model).collect()} == {True}
    assert toxicity.fit(docs_of(spark, []), labels_of(spark, [])).weights == {}


def test_clean_rows_stay(spark):
    docs, labels = corpus()
    table = docs_of(spark, docs + [(1, docs[1][1]), (None, "the an"), (500, None)])
    left = toxicity.keep_clean(table, labels_of(spark, labels))
    assert left.columns == table.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == sorted([i for i, _, t in labels if not t] + [1, -1, 500])


def test_tokens_of_any_length_are_decoded(fitted):
    _, _, model = fitted
    decoder, scorer = toxicity.Decoder(model.characters), model.scorer()
    assert "moron" in decoder.words("m" + "o" * 70 + "ron")
    assert "stupid" in decoder.words("s" + "." * 80 + "tup1d")
    assert scorer.score("the en m" + "o" * 5_000 + "r0n anen") >= 0.5
    # doubled letters behind the first 64 characters
    assert scorer._of_token("." * 70 + "sstuppiidd") > 0
    assert len(decoder.viterbi("a1" * 20_000)) == 40_000


def test_spaced_words_of_few_letters_and_any_white_space(fitted):
    _, _, model = fitted
    decoder, scorer = toxicity.Decoder(model.characters), model.scorer()
    assert toxicity.tokens_of("the a s s en")[1] == ["a s s"] and toxicity.tokens_of("b o o b")[1] == ["b o o b"]
    assert toxicity.tokens_of("a b the c d en ab c")[1] == []
    for blank in ["  ", "\t", "\n", "\u00a0", " \r\n "]:
        spaced = blank.join("moron")
        assert toxicity.tokens_of(f"the {spaced} en")[1] == ["m o r o n"]
        assert toxicity.restored(f"the {spaced} en", decoder).split() == ["the", "moron", "en"]
        assert scorer.score(f"the en {spaced} the en {blank.join('idi0t')}") >= 0.5
    # a run is read as a whole too, so letters repeated often do not push a word out of every stretch
    assert "stupid" in toxicity.read_words("s t " + "u " * 40 + "p i d", decoder)


def test_separators_may_end_words(fitted):
    _, _, model = fitted
    decoder, scorer = toxicity.Decoder(model.characters), model.scorer()
    for c in "-./,_~":
        assert "idiot" in decoder.words(f"shon{c}1d10t") and "idiot" in decoder.words(f"1d10t{c}shon")
        assert scorer.score(f"the en shon{c}1d10t anen the m0r0n{c}er") >= 0.5
        assert "stupid" in decoder.words(c.join("stup1d"))
    assert "idiot" in decoder.words("shon-1.d.1.0.t-en") and "idiot" in decoder.words("shon.1-d-1-0-t")
    # a text with separators in place of all blanks, of more than 64 characters
    assert scorer.score("the-en-anen-the-shon-titi-" * 5 + "w0rthl3ss-1d10t") >= 0.5
    assert scorer.score("the-en-anen-the-shon-titi-" * 5) < 0.5


def test_signs_at_the_edges_may_be_letters(fitted):
    _, _, model = fitted
    decoder, scorer = toxicity.Decoder(model.characters), model.scorer()
    for token in ["a$$", "a$$!!", '"a$$".', "@$$", "(a$$)"]:
        assert "ass" in decoder.words(token), token
    assert "cum" in decoder.words("((um") and "a" in decoder.words("a$$")
    assert decoder.words("the!")[0] == "the" and decoder.words("!!!") == decoder.words("$$$") == []
    assert scorer.score("the en worthle$$ the 1d1o+ en") >= 0.5
    assert len(decoder.words("en" + "!$" * 500)) == 1 + 1000
