"""Byte-level ids against the file's own library, plans and packings against their rules."""
import collections
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabprep.llm import bpe, packing, queries, tokens


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(packing.TOKENIZER)


@pytest.fixture(scope="module")
def model():
    with open(packing.TOKENIZER, encoding="utf-8") as f:
        return bpe.load(f.read())


def test_ids_on_every_code_point(library, model):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 5000):
        texts = [f"x{chr(c)}y 1{chr(c)}2 .{chr(c)}.{chr(c)}{chr(c)} z" for c in points[i:i + 5000]]
        assert [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)] == [model.encode(t).tolist() for t in texts]


def odd_texts():
    return ["", "a", " " * 1_000_000, "x" + " " * 2000 + "y", "x" + " " * 2000, " " * 999 + "\n" * 1500 + "q", "a<|endoftext|>b <|endoftext|>", "　  " * 800 + "\x1f" * 1200 + "z",
            "a" * 100_000, "\x85" * 1200 + "'s", "\n" * 1001 + ".", "Straße 日本 don't 12 " * 400]


def test_ids_of_odd_texts(library, model):
    for t in odd_texts():
        assert model.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_lengths_of_long_white_space(spark, make_docs):
    """Operator 2 counts what the library gives."""
    plain = Tokenizer.from_file(packing.TOKENIZER)
    plain.encode_special_tokens = True
    texts = odd_texts()
    got = {r.id: r.n_tokens for r in tokens.lengths(make_docs(list(enumerate(texts)))).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def unfold(histogram, plan):
    """Every piece of a plan: sequence -> [(offset, length)]."""
    sequences = collections.defaultdict(list)
    for i, (length, rank, each, sequence, offset) in enumerate(zip(plan.length.tolist(), plan.rank.tolist(), plan.each.tolist(), plan.sequence.tolist(), plan.offset.tolist(), strict=True)):
        last = i + 1 == len(plan.rank) or plan.length[i + 1] != length
        for k in range((histogram[length] if last else int(plan.rank[i + 1])) - rank):
            sequences[sequence + k // each].append((offset + k % each * length, length))
    return sequences


def best_fit(histogram, capacity):
    """Sequences of plain best fit, long to short, piece by piece."""
    free = []
    for length in sorted((k for k, n in histogram.items() for _ in range(n)), reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            i = min(fits, key=free.__getitem__)
            free[i] -= length
        else:
            free.append(capacity - length)
    return len(free)


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 7, 64, 1024])
    shape = r.choice([lambda: r.randint(1, capacity), lambda: min(capacity, max(1, int(r.lognormvariate(3, 1)))), lambda: max(1, capacity * r.choice([1, 2, 3, 5, 6]) // 6)])
    histogram = collections.Counter(shape() for _ in range(r.choice([1, 30, 700, 2500])))
    plan = packing.plan(histogram, capacity)
    sequences = unfold(histogram, plan)
    assert collections.Counter(n for s in sequences.values() for _, n in s) == histogram and len(sequences) == plan.sequences
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = -(-sum(k * n for k, n in histogram.items()) // capacity)
    assert total <= plan.sequences <= best_fit(histogram, capacity) * 1.01 + 1


def test_plan_reaches_the_least_number():
    """Three sizes of which best fit wastes one sequence in eleven."""
    histogram = {500: 1000, 300: 1000, 224: 1000}
    assert packing.plan(histogram, 1024).sequences == 1000
    assert packing.plan({}, 1024).sequences == 0
    with pytest.raises(ValueError):
        packing.plan({1025: 1}, 1024)


def test_plan_does_not_grow_with_the_pieces():
    r = np.random.default_rng(1)
    small = collections.Counter(r.integers(1, 1025, 5000).tolist())
    large = {k: 1_000_000 * n for k, n in small.items()}
    assert len(packing.plan(large).rank) < 6000 and packing.plan(large).sequences < 1.02 * sum(k * n for k, n in large.items()) / 1024


def test_packed_documents(spark, make_docs, library):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["the", "cat", "über", "x1"]) for _ in range(int(r.lognormvariate(4, 1.4))))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "w " * 30_000), (403, "same"), (403, "same"), (None, "no id"), (404, " " * 3000)]
    docs = make_docs(rows)
    cut = packing.pieces(docs)
    found = packing.pack(cut.withColumn("offset", cut["piece"]).withColumn("size", cut["piece"])).collect()
    whole = collections.defaultdict(list)
    for i, t in rows:
        whole[i].append(library.encode(t or "", add_special_tokens=False).ids + [2])
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for x in found:
        assert len(x.ids) == 4 * x.length and 1 <= x.length <= 1024 and (x.piece == 0 or x.length == 1024)
        by_doc[x.id].append((x.start, struct.unpack(f"<{x.length}I", x.ids)))
        by_sequence[x.sequence_id].append((x.offset, x.length))
    for i, texts in whole.items():
        ids = [t for _, p in sorted(by_doc[i]) for t in p]
        assert sorted(ids) == sorted(t for x in texts for t in x) and (len(texts) > 1 or ids == texts[0])
    for held in by_sequence.values():
        ends = np.cumsum([n for _, n in sorted(held)])
        assert [o for o, _ in sorted(held)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert packing.pack(cut.where("id = -1")).count() == 0
    odd = packing.pack(spark.createDataFrame([(1, None), (2, 0), (3, 5)], "row int, length int")).collect()
    assert sorted((x.row, x.sequence_id, x.offset) for x in odd if x.row == 3) == [(3, 0, 0)] and all(x.sequence_id is None for x in odd if x.row != 3)


def test_packing_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = set()
    total = 0
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first if k == 0 else a + 1024
            want.add((d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = queries.op12_packing(spark, sf).collect()
    assert len(got) == len(want) and {(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got} == want
    assert len({x.sequence_id for x in got}) < 1.1 * total / 1024 + 1
