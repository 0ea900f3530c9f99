"""The quality classifier's steps against plain loops: contexts, pooling, both layers, temperature."""

import math
import random
import zlib

import numpy as np

from tracelens.llm import quality_classifier as q


def some_texts(n=30, seed=5):
    draw = random.Random(seed)
    words = ["the", "The", "of", "AND", "x_y", "ä1", "!!", "über", "go", "go"]
    return [None, "", " \n ", "one"] + ["\n".join(" ".join(draw.choice(words) for _ in range(draw.randrange(0, 9))) for _ in range(draw.randrange(1, 5))) for _ in range(n)]


def bucket(word):
    return zlib.crc32(word.encode()) % q.BUCKETS


def index_vector(b):
    at, sign = q.index_vectors()
    out = [0] * q.DIM
    for p, s in zip(at[b], sign[b], strict=True):
        out[p] += int(s)
    return out


def test_marks_follow_the_words():
    assert q.tokens("Go GO go\nA b\nA b") == ["go", "go", "go", "a", "b", "a", "b", " capitals", " again", " again", " line"]
    assert q.tokens(None) == q.tokens("") == []


def test_contexts_equal_plain_loops():
    texts = some_texts()
    want = {}
    for t in texts:
        ids = [bucket(w) for w in q.tokens(t)]
        for i, u in enumerate(ids):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(ids):
                    row = want.setdefault(u, [0] * q.DIM)
                    for k, x in enumerate(index_vector(ids[j])):
                        row[k] += x
    got = q.contexts(texts)
    assert {int(b) for b in np.flatnonzero(got.any(axis=1))} <= set(want) and all(got[b].tolist() == row for b, row in want.items())


def test_pooling_equals_plain_loops():
    texts = some_texts()
    context = q.unit(q.contexts(texts))
    pooled = q.pool(texts, q.word_vectors(context), q.Buckets())
    for t, row in zip(texts, pooled, strict=True):
        ids = [bucket(w) for w in q.tokens(t)]
        if not ids:
            assert not row.any()
            continue
        for k in range(q.DIM):
            assert math.isclose(row[k], sum(index_vector(b)[k] for b in ids) / len(ids), abs_tol=1e-5)
            assert math.isclose(row[q.DIM + k], sum(float(context[b][k]) for b in ids) / len(ids), abs_tol=1e-4)
        assert math.isclose(row[-1], math.log(1 + len(ids)))


def learned(seed=3, n=300):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 2 * q.DIM + 1))
    y = (x[:, 0] + 0.5 * x[:, 1] + draw.normal(size=n) * 0.5 > 0).astype(int)
    apart = np.arange(n) % 5 == 0
    return x, y, apart, q.train(x, y, apart, np.zeros((1, 1)))


def test_layers_equal_plain_loops():
    x, _, _, m = learned()
    for row in x[:5]:
        z = [(v - a) / b for v, a, b in zip(row, m.mean, m.scale, strict=True)]
        hidden = [math.tanh(sum(z[i] * m.w1[i, j] for i in range(len(z))) + m.b1[j]) for j in range(q.HIDDEN)]
        logit = sum(h * w for h, w in zip(hidden, m.w2, strict=True)) + m.b2
        assert math.isclose(m.logits(row[None])[0], logit, rel_tol=1e-9) and math.isclose(m.score(row[None])[0], 1 / (1 + math.exp(-logit / m.temperature)), rel_tol=1e-9)


def test_temperature_is_the_best_of_its_grid_and_rows_apart_are_not_fitted_on():
    x, y, apart, m = learned()
    z = m.logits(x[apart])
    loss = lambda c: np.mean([math.log1p(math.exp(-v / c if t else v / c)) for v, t in zip(z, y[apart], strict=True)])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 64))
    assert math.isclose(m.temperature, min(grid, key=loss))
    other = y.copy()
    other[apart] = 1 - other[apart]
    again = q.train(x, other, apart, np.zeros((1, 1)))
    assert (again.w1 == m.w1).all() and again.temperature >= m.temperature
    *_, m = learned(n=3000)
    fresh = np.random.default_rng(9).normal(size=(500, 2 * q.DIM + 1))
    right = (m.score(fresh) >= 0.5) == (fresh[:, 0] + 0.5 * fresh[:, 1] > 0)
    assert right.mean() > 0.75


def test_one_label_gives_its_rate():
    x, y, apart, _ = learned()
    m = q.train(x, np.ones_like(y), apart, np.zeros((1, 1)))
    assert np.allclose(m.score(x), 301 / 302)
