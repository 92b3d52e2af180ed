"""SimHash near-duplicates by the generalised pigeonhole principle (operator 3).

Every text gets a 64-bit SimHash of its word shingles. Two fingerprints that
differ in at most ``distance`` bits are linked, and linked texts form groups.

The 64 bits are grouped so that correlated bits share a partition. If the
thresholds of m partitions add up to distance - m + 1, two fingerprints within
``distance`` bits lie within the threshold of at least one partition. Each
fingerprint gets its own thresholds (from -1, not probed, upwards) by dynamic
programming over the expected number of candidates of each partition and
threshold; it probes the index with every value within them, and the join
verifies whole fingerprints. Nothing is capped: every probe meets every
fingerprint of its bucket.

Estimates come from all fingerprints: an exact histogram of each block of eight
bits, blocks of a partition taken as independent. They steer cost only; a bad
estimate never loses a link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.components import components
from tabprep.llm.words import SPACE, Words, slices
from tabprep.session import cut_lineage

BLOCK = 8
BYTES_SET = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Cost of a probe (a row that is shuffled and sorted) in verified candidates.
PROBE_COST = 10.0


def bits_of(column: pa.Array, shingle: int, seed: int) -> np.ndarray:
    """Fingerprint of each row, as uint64."""
    words = Words(column, SPACE, fold=True, hashed=False)
    out = np.zeros(len(words.count), np.uint64)
    raw = words.raw.tobytes()
    digest = xxhash.xxh64_intdigest
    for row in np.flatnonzero(words.count):
        a, b = words.first[row], words.first[row + 1]
        start, end = words.start[a:b], words.end[a:b]
        size = end - start
        at = np.concatenate([[0], np.cumsum(size + 1)])
        joined = b" ".join([raw[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)])
        k = min(shingle, b - a)
        n = len(size) - k + 1
        left, right = at[:n].tolist(), (at[k : k + n] - 1).tolist()
        h = np.array([digest(joined[i:j], seed) for i, j in zip(left, right, strict=True)], np.uint64)
        ones = np.zeros(64, np.int64)
        for lo in range(0, n, 1 << 16):
            piece = h[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, digest, bits): xxhash64 of each row's text, and its SimHash. Words are runs of non-white-space, A-Z lower-cased;
    a text of fewer words than a shingle is one shingle; null, empty and wordless texts get zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bits = bits_of(batch.column("text"), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(bits.view(np.int64))], names=["id", "digest", "bits"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    return rows.mapInArrow(run, "id long, digest long, bits long")


def _cells(table: DataFrame, count, cells: int) -> np.ndarray:
    """Sum of count(bits) -> array of ``cells`` numbers over all rows; a row per cell and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], names=["cell", "n"])

    out = np.zeros(cells)
    for r in table.select("bits").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(bits).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(pairs: np.ndarray, n: float) -> list[int]:
    """An order of the 64 bits in which blocks of eight hold correlated bits, and neighbouring blocks too.
    pairs[i, j]: fingerprints with both bits set."""
    p = np.diag(pairs) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((pairs / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, order = set(range(64)), []
    while left:
        block: list[int] = []
        while len(block) < BLOCK:
            near = block or order[-BLOCK:]
            score = corr[near].sum(axis=0) if near else corr.sum(axis=0)
            best = max(sorted(left), key=lambda i: score[i])
            left.remove(best)
            block.append(best)
        order += block
    return order


class Plan:
    """Partitions of the bits and the allocation of thresholds."""

    def __init__(self, order: list[int], histogram: np.ndarray, n: float, parts: int, distance: int):
        self.order, self.parts, self.distance, self.n = order, parts, distance, n
        self.blocks = np.array_split(np.arange(64 // BLOCK), parts)
        self.width = [BLOCK * len(b) for b in self.blocks]
        near = np.zeros((64 // BLOCK, 256, BLOCK + 1))
        apart = BYTES_SET[np.arange(256)[:, None] ^ np.arange(256)[None, :]]
        for b in range(64 // BLOCK):
            for d in range(BLOCK + 1):
                near[b, :, d] = (apart == d) @ (histogram[b] / max(n, 1))
        self.near = near
        self.flips = [[[sum(1 << i for i in c) for e in range(t + 1) for c in itertools.combinations(range(w), e)]
                       for t in range(min(distance, 2) + 1)] for w in self.width]

    def blocks_of(self, bits: np.ndarray) -> np.ndarray:
        """(rows, 8): the value of each block of reordered bits."""
        return np.packbits(_unpacked(bits)[:, self.order], axis=1, bitorder="little")

    def values(self, blocks: np.ndarray, part: int) -> np.ndarray:
        out = np.zeros(len(blocks), np.uint64)
        for shift, b in enumerate(self.blocks[part]):
            out |= blocks[:, b].astype(np.uint64) << np.uint64(BLOCK * shift)
        return out

    def allocate(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Threshold of each row and partition, and the row's expected cost, by dynamic programming."""
        n, top = len(blocks), min(self.distance, 2)
        cost = np.zeros((self.parts, n, top + 2))  # [part, row, threshold + 1]
        for i, own in enumerate(self.blocks):
            spread = np.zeros((n, top + 1))
            spread[:, 0] = 1
            for b in own:
                near, grown = self.near[b][blocks[:, b]], np.zeros((n, top + 1))
                for d in range(top + 1):
                    for e in range(d + 1):
                        grown[:, d] += spread[:, d - e] * near[:, e]
                spread = grown
            within = np.cumsum(spread, axis=1) * self.n
            for t in range(top + 1):
                cost[i, :, t + 1] = within[:, t] + PROBE_COST * len(self.flips[i][t])
        budget = self.distance + 1  # thresholds + 1 add up to it
        best = np.full((n, budget + 1), np.inf)
        best[:, 0] = 0
        took = np.zeros((self.parts, n, budget + 1), np.int8)
        for i in range(self.parts):
            new = np.full((n, budget + 1), np.inf)
            for s in range(budget + 1):
                for t in range(min(s, top + 1) + 1):
                    c = best[:, s - t] + cost[i, :, t]
                    better = c < new[:, s]
                    new[better, s] = c[better]
                    took[i, better, s] = t
            best = new
        out, left, rows = np.zeros((n, self.parts), np.int64), np.full(n, budget), np.arange(n)
        for i in reversed(range(self.parts)):
            out[:, i] = took[i, rows, left]
            left = left - out[:, i]
        return out - 1, best[:, budget]


def links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b): pairs of distinct fingerprints of ``classes`` (column bits) at ``distance`` bits or fewer; a pair may come twice."""
    spark = classes.sparkSession
    pairs = _cells(classes, lambda x: (lambda u: u.T @ u)(_unpacked(x).astype(np.float64)).ravel(), 4096).reshape(64, 64)
    n = float(classes.count())
    order = group_bits(pairs, n)
    shell = Plan(order, np.zeros((64 // BLOCK, 256)), n, 2, distance)
    histogram = _cells(classes, lambda x: np.concatenate([np.bincount(c, minlength=256) for c in shell.blocks_of(x).T]).astype(float), 2048).reshape(-1, 256)
    plans = [Plan(order, histogram, n, m, distance) for m in range(max(2, (distance + 3) // 3), min(64 // BLOCK, distance + 1) + 1)]
    costs = _cells(classes, lambda x: np.array([p.allocate(p.blocks_of(x))[1].sum() for p in plans]), len(plans))
    plan = spark.sparkContext.broadcast(plans[int(np.argmin(costs))])

    def keys(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
        p: Plan = plan.value
        for batch in batches:
            bits = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(bits), 1 << 14):
                own = bits[lo : lo + (1 << 14)]
                blocks = p.blocks_of(own)
                given = p.allocate(blocks)[0] if probe else np.zeros((len(own), p.parts), np.int64)
                for i in range(p.parts):
                    value = p.values(blocks, i)
                    for t in np.unique(given[:, i][given[:, i] >= 0]):
                        rows = np.flatnonzero(given[:, i] == t)
                        flips = np.array(p.flips[i][t], np.uint64)
                        key = (value[rows][:, None] ^ flips[None, :]).ravel() | np.uint64(i) << np.uint64(60)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key.view(np.int64)), pa.array(np.repeat(own[rows], len(flips)).view(np.int64))], names=["key", "bits"])

    schema = "key long, bits long"
    index = classes.select("bits").mapInArrow(lambda b: keys(b, False), schema).withColumnRenamed("bits", "b")
    probes = classes.select("bits").mapInArrow(lambda b: keys(b, True), schema).withColumnRenamed("bits", "a")
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return probes.join(index, (probes["key"] == index["key"]) & near).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """One row per row of ``docs``: id, digest (xxhash64 of the text), bits (SimHash as a signed long), root (the same for all rows
    that links reach), component (their smallest id).

    Null, empty and wordless texts have fingerprint zero and are linked like any
    other. Rows with a repeated id keep a row each, and two components may then
    have one name. A null id is never a component's name unless the component has no other. An empty table gives an
    empty result. Other columns are not read.
    """
    marked = cut_lineage(fingerprints(docs, id_col, text_col, shingle, seed))
    classes = cut_lineage(marked.groupBy("bits").agg(F.min("id").alias("smallest")))
    roots = components(links(classes, distance))
    named = classes.join(roots.select(F.col("node").alias("bits"), "root"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    smallest = named.groupBy("root").agg(F.min("smallest").alias("component"))
    owner = named.join(smallest, "root").select("bits", "root", "component")
    return marked.join(owner, "bits").select("id", "digest", "bits", "root", "component")
