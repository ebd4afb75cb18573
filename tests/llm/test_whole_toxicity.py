"""Toxic phrases of ordinary words, and texts that are no near copies."""

from __future__ import annotations

import random

from revlens.llm import toxicity

PARTS = "ba den fir gol hem jin kap lor mus net pol ras sit tul ven".split()
WORDS = [*"we will find you where sleep".split(), *[a + b for a in PARTS for b in PARTS]]


def prose(rng, n=60):
    return [rng.choice(WORDS) for _ in range(n)]


def test_texts_of_common_words_stay():
    rng = random.Random(3)
    texts = [" ".join([*prose(rng), "something", "another"]) for _ in range(50)]
    copy = texts[0].split()
    copy[30] = "changed"
    assert toxicity.unlike([*texts, " ".join(copy), texts[7]]) == texts


def test_phrases_of_ordinary_words():
    rng = random.Random(5)
    texts, toxic = [], []
    for i in range(400):
        w = prose(rng)
        if i % 5 < 2:
            at = rng.randrange(len(w))
            w[at:at] = "we will find you where you sleep".split()
        else:  # the same words, dealt out
            for x in "we will find you where you sleep".split():
                w.insert(rng.randrange(len(w)), x)
        texts.append(" ".join(w))
        toxic.append(int(i % 5 < 2))
    model = toxicity.fit(texts, toxic, 0.4)
    assert any(model.weights[1:])
    compressors = model.compressors()
    told = [(toxicity.features(toxicity.distances(compressors, t), model.thresholds) * model.weights).sum() >= 0 for t in texts]
    assert sum(t == bool(y) for t, y in zip(told, toxic, strict=True)) > 0.85 * len(texts)


def test_toxic_windows_are_learned_without_telling_runs(monkeypatch):
    monkeypatch.setattr(toxicity, "telling_runs", lambda bad, good: [])
    rng = random.Random(7)
    texts = [" ".join([*prose(rng), *(["despicable"] if i % 5 < 2 else [])]) for i in range(200)]
    model = toxicity.fit(texts, [int(i % 5 < 2) for i in range(200)], 0.4)
    assert model.toxic[0] and any(model.weights[1:])
