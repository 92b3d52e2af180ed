"""The k nearest rows of a pair of blocks against plain distances of all pairs."""
import numpy as np
import pandas as pd
import pytest

from tabprep.operators import learners as L


def plain(q, t, k, metric):
    out = []
    for key, v in zip(q.id, q.v, strict=True):
        diff = np.stack(t.v) - v
        d = np.abs(diff).sum(axis=1) if metric == "manhattan" else np.sqrt((diff**2).sum(axis=1))
        order = np.lexsort((t["_tid"], d))[:k]
        out += [(key, tid, x) for tid, x in zip(t["_tid"].to_numpy()[order], d[order], strict=True)]
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("kind", ["normal", "grid", "far", "copies", "nan", "huge"])
def test_same_as_all_pairs(kind, metric):
    r = np.random.default_rng(3)
    x = {"normal": r.normal(size=(700, 8)), "grid": r.integers(0, 2, (700, 4)), "far": 1e9 + r.integers(0, 3, (700, 3)), "copies": np.ones((700, 3)),
         "nan": np.where(r.random((700, 3)) < 0.01, np.nan, r.normal(size=(700, 3))), "huge": r.normal(size=(700, 3)) * 1e200}[kind].astype(float)
    ids = r.permutation(700)
    t = pd.DataFrame({"_tid": ids[:600], "v": list(x[:600]), "_y": 0})
    q = pd.DataFrame({"id": ids[600:], "v": list(x[600:])})
    with np.errstate(over="ignore", invalid="ignore"):
        got = L._nearest(7, metric, "id", "v")(q, t)
        want = plain(q, t, 7, metric)
    assert [(a, b) for a, b in zip(got.id, got["_tid"], strict=True)] == [w[:2] for w in want]
    assert np.array_equal(got["_d"].to_numpy(), [w[2] for w in want], equal_nan=True)


def test_euclid_forms_no_differences_of_all_pairs(monkeypatch):
    monkeypatch.setattr(L, "_distances", None)
    r = np.random.default_rng(4)
    t = pd.DataFrame({"_tid": range(2000), "v": list(r.normal(size=(2000, 16))), "_y": 0})
    q = pd.DataFrame({"id": range(40), "v": list(r.normal(size=(40, 16)))})
    pairs = sum(len(rows) for _, rows, _, _ in L._few(np.stack(q.v), np.stack(t.v), 5, "euclidean"))
    assert len(L._nearest(5, "euclidean", "id", "v")(q, t)) == 200 <= pairs < 400
