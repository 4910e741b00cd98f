"""The toxicity decoder against every path through its lattices."""

import random

import numpy as np
import pytest

from lemmaforge.llm import toxicity


def paths(steps, model):
    """(score, words, text) of every reading of a lattice."""
    out = [(0.0, 0, "", (), "")]
    for arcs in steps:
        after = []
        for score, s, part, words, text in out:
            for emit, k, cost in arcs:
                if emit == "":
                    if k and not s:
                        continue
                    after.append((score - cost, s, part, words, text))
                elif k:
                    after.append((score + model.rows[s][k] - cost, k, part + emit, words, text + emit))
                elif emit == " ":
                    after.append((score + model.ends[s] - cost, 0, "", (*words, part) if part else words, text + emit))
                else:
                    after.append((score + model.ends[s] - cost, 0, part + emit, words, text + emit))
        out = after
    return [(score + model.ends[s], {*words, part} - {""}, text) for score, s, part, words, text in out]


@pytest.fixture(scope="module")
def model():
    return toxicity.CharModel(np.random.default_rng(3).integers(0, 400, 729))


def test_every_path(model, monkeypatch):
    """With room for all readings, the words are those of the readings within the margin, and the best reading is the best path."""
    monkeypatch.setattr(toxicity, "LISTED", 10**6)
    rng = random.Random(4)
    for _ in range(250):
        run = "".join(rng.choice("aab10$!|. -é") for _ in range(rng.randrange(1, 8)))
        for edges in (True, False):
            steps = toxicity._arcs(run, edges, rng.choice([toxicity.COST_MARK, toxicity.COST_SIGN]))
            every = paths(steps, model)
            if not every:
                continue
            best = max(x[0] for x in every)
            words, text = model._lattice(steps)
            want = set().union(*(w for score, w, _ in every if score >= best - toxicity.MARGIN - 1e-9))
            near = set().union(*(w for score, w, _ in every if score >= best - toxicity.MARGIN + 1e-6))
            assert near <= words <= want, run
            assert any(t == text and score == pytest.approx(best) for score, _, t in every), run


def test_a_short_list_loses_no_best_word(model):
    """As many readings as are kept give words of readings within the margin only, those of the best among them."""
    rng = random.Random(5)
    for _ in range(150):
        run = "".join(rng.choice("aab10$!|.") for _ in range(rng.randrange(1, 8)))
        steps = toxicity._arcs(run, True, toxicity.COST_MARK)
        every = paths(steps, model)
        best = max(x[0] for x in every)
        words, _ = model._lattice(steps)
        assert words <= set().union(*(w for score, w, _ in every if score >= best - toxicity.MARGIN - 1e-6))
        assert any(w <= words for score, w, _ in every if score >= best - 1e-9)


def test_repeated_letters_of_any_number(model, monkeypatch):
    monkeypatch.setattr(toxicity, "LISTED", 10**6)
    for word in ("aab", "baaaaaaaaaab", "ééééééééé", "abbbaab"):
        best = {}
        for score, words, _ in paths(toxicity._arcs(word, False, 1.0), model):
            for w in words:
                best[w] = max(score, best.get(w, -1e9))
        top = max(best.values())
        assert {w for w, x in best.items() if x >= top - toxicity.MARGIN + 1e-6} <= model._thinned(word) | {word}


def test_long_words_stay_whole(model):
    for word in ("ab" * 60, "abc" * 400, "a" * 3000 + "b"):
        assert word[-50:] in {w[-50:] for w in model.words(word)}
    assert not any(len(w) == 64 for w in model.words("xy" * 60 + "-1"))


def test_disguises():
    chars = toxicity.CharModel(np.ones(729))
    model = toxicity.ToxicityModel(chars, 0.1, {"idiot": 0.9, "moro*": 0.9, "stupid": 0.9}, apart=frozenset({"idiot", "stupid"}))
    for text in ("such an id iot", "st upid", "id*ot", "st#pid!", "іdіot", "ｉｄｉｏｔ", "ídiöt", "mоrоn", "idi​ot", "(id iot)"):
        assert model.score(text) >= 0.5, text
    for text in ("id i", "iot id", "mo ronly", "a*b stupi", "i* d", "moro"[:3]):
        assert model.score(text) < 0.5, text
