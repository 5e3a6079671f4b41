"""The language model's tasks: distinct words are looked up once, steps are summed without a sort, tables take no copies."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402
from bourse.llm import neural_lm  # noqa: E402

ODD = ["", " ", "\n\x0b\x0c\t\r ", " a  B\x0bc\x0cD\r\nÉ ", "a\x1cb\xa0c d \x00", "zoning ZONING 😀😀x xyz", "İstanbul ẞ", "zoning " * 5]


def _vocabulary() -> neural_lm.Vocabulary:
    ones = np.ones(neural_lm.OUTPUTS, np.int64)
    return neural_lm.Vocabulary({}, {b"a": 1, "É".encode(): 2}, {"ing": 1 + neural_lm.FREQUENT, "b": 2 + neural_lm.FREQUENT}, ones, ones, 1, 1)


def test_distinct_words_are_looked_up_once(monkeypatch):
    v = _vocabulary()
    cut = [[w.encode() for w in plain.lower_words(text)] for text in ODD]
    want = [0, 0] + [t for words in cut for t in [*map(v.output, words), 0]]
    monkeypatch.setattr(neural_lm.Vocabulary, "output", None)  # it is not called word by word
    words, tokens, ends = neural_lm.Encoder(v).stream(ODD)
    assert [w.encode() for w in words.to_pylist()] == [w for some in cut for w in some] and len(words.dictionary) == len({w for some in cut for w in some})
    assert tokens.tolist() == want and ends.tolist() == (np.cumsum([len(some) + 1 for some in cut]) + 1).tolist()
    words, tokens, ends = neural_lm.Encoder(v).stream(["", ""])
    assert (len(words), tokens.tolist(), ends.tolist()) == (0, [0] * 4, [2, 3])


@pytest.mark.parametrize("kept", [1 << 18, 3])
def test_words_are_counted_whatever_a_task_holds(spark, monkeypatch, kept):
    monkeypatch.setattr(neural_lm, "KEPT", kept)
    monkeypatch.setattr(neural_lm, "CUT", 20)
    texts = spark.createDataFrame([(t,) for t in [*ODD, *(f"w{k % 7} a w{k % 5}" for k in range(60))]], "_text string").coalesce(2)
    want: dict[str, int] = {}
    for r in texts.collect():
        for w in plain.lower_words(r._text):
            want[w] = want.get(w, 0) + 1
    assert {r.word: r.c for r in neural_lm.word_counts(texts).collect()} == want


def test_a_step_sums_without_a_sort(monkeypatch):
    """Against loops over the batch, with a start at which nothing is zero."""
    rng = np.random.default_rng(5)
    noise = neural_lm.noise_of(_vocabulary())
    model, first = neural_lm.Model.start(noise), neural_lm.Model.start(noise)
    x, y, t = rng.integers(0, 9, (3, 300)) ** 3
    trainer = neural_lm.Trainer(model, noise, 0.1, 3)
    n = np.minimum(np.searchsorted(trainer.upto, np.random.default_rng(3).random(neural_lm.NOISE)), neural_lm.OUTPUTS - 1)
    monkeypatch.setattr(np, "argsort", None)
    trainer.step(x, y, t)
    inner, outer = np.zeros((2, neural_lm.OUTPUTS, neural_lm.WIDTH))
    bias, place = np.zeros(neural_lm.OUTPUTS), np.zeros((2, neural_lm.WIDTH))
    flat = neural_lm.Model(first.flat.astype(float))
    for i, j, k in zip(x, y, t, strict=True):
        p = flat.inner[i] * flat.place[0] + flat.inner[j] * flat.place[1]
        up = np.zeros(neural_lm.WIDTH)
        for sign, q in [(1, k), *((-1, q) for q in n)]:
            pull = sign / (1 + np.exp(sign * (p @ flat.outer[q] + flat.bias[q] - np.log(neural_lm.NOISE * noise[q]))))
            up += pull * flat.outer[q]
            outer[q] += pull * p
            bias[q] += pull
        inner[i] += up * flat.place[0]
        inner[j] += up * flat.place[1]
        place += [up * flat.inner[i], up * flat.inner[j]]
    for now, old, summed in ((model.inner, flat.inner, inner), (model.outer, flat.outer, outer), (model.place, flat.place, place)):
        scale = np.sqrt(neural_lm.SEEN + (summed * summed).mean(axis=1, keepdims=True) + 1e-6)
        assert np.allclose(now, old + 0.1 * summed / scale, atol=2e-5)
    assert np.allclose(model.bias, flat.bias + 0.1 * bias / np.sqrt(neural_lm.SEEN + bias * bias), atol=2e-5)
