"""Words without a chance of a weight cost the scorer next to nothing, and its scores stay the same."""

import numpy as np
import pytest

from metricledger.llm import toxicity as T

WEIGHTS = {"scum": 3.0, "tra*": 2.0, "idiot*": 4.0, "ox": 1.5, "hatef*": 2.5}


@pytest.fixture
def model():
    rng = np.random.default_rng(3)
    return T.Model(rng.normal(-3, 1, (T.SYMBOLS,) * 3), WEIGHTS, [-3.0, 1.0, 0.5, 0.2, 0.1])


def test_words_that_no_weight_begins_are_not_taken_apart(model, monkeypatch):
    taken, features = [], T.features
    monkeypatch.setattr(T, "features", lambda word: taken.append(word) or features(word))
    model.scorer().score("the quick brown fox, jumps over (lazy) dogs. scum trash")
    assert set(taken) == {"scum", "trash"}


@pytest.mark.parametrize("word", ["", "o", "ox", "oxen", "scum", "scums", "tr", "tra", "trap", "idiots", "idio", "hate", "hateful", "hatef"])
def test_weight_is_the_largest_of_its_features(model, word):
    assert model.scorer()._of_word(word) == max((WEIGHTS[f] for f in T.features(word) if f in WEIGHTS), default=0.0)


@pytest.mark.parametrize("token, read", [("word.", False), ("(word)", True), ("word!", True), ("\"word\"", False), ("word;;", False), (".,;", False)])
def test_edges_are_read_where_they_may_stand_for_letters(model, monkeypatch, token, read):
    decoder, asked = T.Decoder(model.characters), []
    monkeypatch.setattr(decoder, "beginnings", lambda *a: asked.append(a) or [""])
    core = token.strip(T.BRACKETS).rstrip(T.ENDINGS)
    decoder._of_edges(token, core, False)
    assert bool(asked) == read
