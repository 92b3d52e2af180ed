"""Room that the language model takes on disk: packed lines."""
import numpy as np
import pandas as pd
import pyarrow as pa

from tabprep.llm import hpylm


def test_contexts_rows_and_places_take_less_than_their_widest_step(monkeypatch):
    monkeypatch.setattr(hpylm, "chunk_name", lambda sequence: 0)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"v{k}" for k in rng.zipf(1.3, 300) % 5000) for _ in range(600)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts)], names=["id", "text"])
    sent = pa.Table.from_batches(hpylm._send(iter([rows]), 1, np.zeros(0, np.uint64))).to_pandas()
    line, body = sent[sent.part >= 0].iloc[0], sent[sent.rows.notna()].iloc[0]
    pairs = int(hpylm.expand(line["runs"]).sum())
    assert len(line["contexts"]) < 1.6 * pairs
    assert len(body["rows"]) < 1.6 * int(hpylm.expand(body["counts"]).sum())
    merged = hpylm._merge(pd.concat([sent[sent.part >= 0]] * 2))
    own = hpylm.Range(0, merged)
    for said in merged[merged.chunk >= 0].counts:
        assert np.cumsum(hpylm.expand(said)).tolist() == list(range(pairs))
    context = hpylm.climbed(line["contexts"], hpylm.expand(line["runs"]))
    assert own.context.tolist() == context.tolist() and len(own.names) == len(np.unique(context))
    assert hpylm.climbed(hpylm.climb(np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(0, np.int64)).tolist() == []
