"""Lock-step boosting against separate runs and a plain version."""
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabprep.operators import boosting as B


def sample(spark, n=600, k=3, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    x[:, 3] = r.integers(0, 2, n)
    x[r.random(n) < 0.05, 0] = np.nan
    y = (np.digitize(np.nan_to_num(x[:, 0]) + 0.7 * x[:, 1], [-0.6, 0.6]) % k + (r.random(n) < 0.1)) % k
    rows = [(Vectors.dense(a.tolist()), float(b), int(i % 3)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ["features", "label", "fold"]), x, y


def plain(x, y, cuts, k, rate, rounds):
    """One run over whole arrays."""
    w, out = np.ones(len(y)), []
    bins = np.stack([np.where(np.isnan(x[:, f]), len(c), np.searchsorted(c, x[:, f], "left")) for f, c in enumerate(cuts)], axis=1)
    for _ in range(rounds):
        total = np.bincount(y, w, k)
        best = None
        for f, ends in enumerate(cuts):
            for s in range(len(ends)):
                left = np.bincount(y[bins[:, f] <= s], w[bins[:, f] <= s], k)
                right = total - left
                if left.sum() > 0 and right.sum() > 0:
                    gain = left @ left / left.sum() + right @ right / right.sum()
                    if best is None or gain > best[0] * (1 + 1e-12):
                        best = (gain, f, s, left.argmax(), right.argmax())
        _, f, s, one, other = best
        said = np.where(bins[:, f] <= s, one, other)
        error = w[said != y].sum() / w.sum()
        if error >= 1 - 1 / k:
            break
        alpha = rate * (math.log((1 - error) / error) + math.log(k - 1))
        out.append((f, s, int(one), int(other), alpha))
        w = np.where(said != y, w * math.exp(alpha), w)
        w /= w.sum()
    return out


def brief(stumps):
    return [(s.feature, s.split, s.left, s.right, s.alpha) for s in stumps]


def same(a, b):
    return len(a) == len(b) and all(x[:4] == y[:4] and math.isclose(x[4], y[4], rel_tol=1e-6) for x, y in zip(a, b, strict=True))


def test_runs_equal_a_plain_one(spark, monkeypatch):
    monkeypatch.setattr(B, "KEEP", 4)
    monkeypatch.setattr(B, "CHUNK", 100)
    df, x, y = sample(spark)
    runs = [B.Run(1.0, None), B.Run(0.3, 1), B.Run(1.0, 2)]
    B.lockstep(df, runs, 10, [0.0, 1.0, 2.0])
    cuts = B.thresholds(df, "features")
    fold = np.arange(len(y)) % 3
    assert same(brief(runs[0].stumps), plain(x, y, cuts, 3, 1.0, 10))
    assert same(brief(runs[1].stumps), plain(x[fold != 1], y[fold != 1], cuts, 3, 0.3, 10))
    alone = [B.Run(1.0, 2)]
    B.lockstep(df, alone, 10, [0.0, 1.0, 2.0])
    assert same(brief(runs[2].stumps), brief(alone[0].stumps))


def test_search_and_prediction(spark):
    df, x, y = sample(spark)
    grid = [{"n_estimators": n, "learning_rate": r} for n in (3, 8) for r in (0.05, 1.0)]
    best, stumps = B.search(df, grid, 3, [0.0, 1.0, 2.0])
    assert best in grid and len(stumps) == best["n_estimators"]
    got = B.predict(stumps, [0.0, 1.0, 2.0], df).select("label", "prediction", "probability").collect()
    assert all(math.isclose(sum(r.probability), 1.0) for r in got)
    accuracy = np.mean([r.label == r.prediction for r in got])
    assert accuracy > 1.2 * max(np.bincount(y)) / len(y)
    cuts = B.thresholds(df, "features")
    bins = np.stack([np.where(np.isnan(x[:, f]), len(c), np.searchsorted(c, x[:, f], "left")) for f, c in enumerate(cuts)], axis=1)
    votes = np.zeros((len(y), 3))
    for s in stumps:
        votes[np.arange(len(y)), np.where(bins[:, s.feature] <= s.split, s.left, s.right)] += s.alpha
    assert np.mean(votes.argmax(axis=1) == y) == pytest.approx(accuracy)


def test_odd_tables(spark):
    one = spark.createDataFrame([(Vectors.dense([1.0]), 1.0, 0)] * 5, ["features", "label", "fold"])
    best, stumps = B.search(one, [{"n_estimators": 5}], 0, [1.0])
    assert {r.prediction for r in B.predict(stumps, [1.0], one).collect()} == {1.0}
    perfect = spark.createDataFrame([(Vectors.dense([float(i)]), float(i > 4), i % 2) for i in range(10)], ["features", "label", "fold"])
    _, stumps = B.search(perfect, [{"n_estimators": 9}], 0, [0.0, 1.0])
    assert len(stumps) == 1 and B.predict(stumps, [0.0, 1.0], perfect).where(F.col("prediction") != F.col("label")).isEmpty()
