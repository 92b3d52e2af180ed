"""Rounds of the language model: what is kept and sent between sweeps."""
import numpy as np
import pandas as pd
import pyarrow as pa

from tabprep.llm import hpylm
from tabprep.session import cut_in_place


def test_squeeze_round_trip():
    for v in ([], [0], [1, 2, 300] * 50, [2**40, 7]):
        assert hpylm.expand(hpylm.squeeze(np.array(v, np.int64))).tolist() == v


def test_ranges_stay_where_they_are(spark):
    kept = cut_in_place(spark.range(100).selectExpr("cast(id % 9 as int) AS part", "id").repartition(30, "part").groupBy("part").agg({"id": "sum"}))
    assert kept.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true"
    told = spark.range(9).selectExpr("cast(id as int) AS part", "id AS n")
    joined = kept.where("part >= 0").groupBy("part").cogroup(told.groupBy("part")).applyInPandas(lambda a, b: pd.DataFrame({"n": [len(a) * len(b)]}), "n long")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan
    assert [r.n for r in joined.collect()] == [1] * 9


def test_scores_draw_the_sweeps_whose_totals_were_counted(monkeypatch):
    monkeypatch.setattr(hpylm, "chunk_name", lambda sequence: sequence)
    texts = [" ".join(f"v{(i * 7 + k * k) % 40}" for k in range(200)) for i in range(40)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(texts)], names=["id", "text"])
    sent = pa.Table.from_batches(hpylm._send(iter([rows]), 1, np.zeros(0, np.uint64))).to_pandas()
    lines = hpylm._merge(sent[sent.part >= 0])
    assert lines["counts"].map(type).eq(bytes).all()
    m = hpylm.Model(1, np.zeros(0, np.uint64))
    r = hpylm.Range(0, lines)
    m.tokens, m.vocabulary = int(r.count.sum()), len(r.words)
    told = [(0, hpylm.TOKENS, hpylm.squeeze(hpylm._by_context(r, r.count)), None)]
    seats = []
    for k in range(3):
        r = hpylm.Range(0, lines, pd.DataFrame(told, columns=["part", "sweep", "a", "b"]))
        tables, _, numbers = hpylm._seats(r, m, k)
        seats.append(r.seats[0].tolist())
        told = [x for x in told if x[1] != hpylm.STATE] + [(0, k, hpylm.squeeze(tables), None), (0, hpylm.STATE, *map(hpylm.squeeze, r.seats))]
        m.parent_discount = 0.6
        m.parent.append((int(numbers[0]), int(numbers[1])))
        m.spread_seats.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
    again = hpylm.Range(0, lines, pd.DataFrame([x for x in told if x[1] != hpylm.STATE], columns=["part", "sweep", "a", "b"]))
    for k in range(3):
        again.sweep(m, k)
        assert again.seats[0].tolist() == seats[k]
