"""Seating of the language model at sizes and sweep counts of production."""
import inspect

import numpy as np
import pyarrow as pa
import pytest

from tabprep.llm import hpylm


def tables(c, w, d, most):
    """Mean and deviation of t when P(t) is proportional to S(c, t) * w**t."""
    k = np.arange(most + 1)
    s = np.full(most + 1, -np.inf)
    s[0] = 0.0
    for n in range(c):
        with np.errstate(divide="ignore"):
            stay = s + np.log(np.maximum(n - d * k, 1e-300))
        s = np.logaddexp(stay, np.concatenate([[-np.inf], s[:-1]]))
    p = s + k * np.log(w)
    p = np.exp(p - p.max())
    p /= p.sum()
    mean = p @ k
    return mean, np.sqrt(p @ (k - mean) ** 2)


@pytest.mark.parametrize("c, w, d", [(40, 3.0, 0.6), (3000, 0.8, 0.6), (3000, 20.0, 0.75), (3000, 900.0, 0.7)])
def test_seating_forgets_its_first_draw(c, w, d):
    sweeps = inspect.signature(hpylm.score).parameters["sweeps"].default
    mean, deviation = tables(c, w, d, c)
    rng = np.random.default_rng(1)
    for first in (1, c // 20):
        t = np.full(1000, first)
        for _ in range(sweeps):
            t = hpylm.sweep(np.full(1000, c), t, np.full(1000, w), d, rng)
        assert abs(t.mean() - mean) < 0.1 * mean and abs(t.std() / deviation - 1) < 0.2, (first, t.mean(), mean, t.std(), deviation)


def test_every_word_before_has_its_own_restaurant(spark, make_docs, monkeypatch):
    words = [f"w{i}" for i in range(100_000)]
    _, context, _ = hpylm.tokens_of(pa.array([" ".join(words)]))
    assert len(np.unique(context)) == len(words) + 1
    rows = [(i, " ".join(f"v{(i * 7 + k * k) % 400}" for k in range(60))) for i in range(40)]
    one = {r.id: r.score for r in hpylm.score(make_docs(rows)).collect()}
    with monkeypatch.context() as patch:  # totals of contexts that many ranges hold
        patch.setattr(hpylm, "ranges_for", lambda *_: 5)
        many = {r.id: r.score for r in hpylm.score(make_docs(rows)).collect()}
    assert one.keys() == many.keys() and abs(sum(one.values()) / sum(many.values()) - 1) < 0.02
