"""Best-fit packing of documents into sequences by linear grouping (operator 12).

Texts become token ids, each document ended by one id; a longer document than a
sequence is cut into whole sequences and one shorter first piece. Lengths are at
most the capacity, so that a histogram of lengths tells all that a packing
depends on, whatever the number of pieces, and the driver plans on that alone:

- the large lengths are put in groups of equal cardinality, from long to short,
  and each rounded up to its group's longest;
- the few rounded sizes are packed optimally but for fractions: a linear program
  over configurations (multisets of sizes that fit), whose columns a knapsack
  finds, rounded down;
- actual pieces take the places of the rounded ones, the last place of a sequence
  the longest piece that what is really free there holds;
- best fit puts the rest, long to short, where they leave least free: the small
  pieces and the large ones that rounding down left over.

A plan is a table of runs: so many pieces of one length, from this one on, go to
so many sequences from this one on, at this offset. Its size is bounded by the
capacity, the groups and the configurations. Spark numbers the pieces of each
length and looks the runs up.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.llm import bpe
from tabprep.llm.words import slices
from tabprep.session import ensure_checkpoint_dir

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Tokens of a sequence, the id that ends a document, groups of large lengths, and the shares of the capacity that large
#: lengths exceed: each gives a plan, and the one of fewest sequences is taken.
CAPACITY, END, GROUPS, SMALL = 1024, 2, 96, (0.34, 0.25, 0.2, 0.1)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_file: str = TOKENIZER, capacity: int = CAPACITY, end_id: int = END) -> DataFrame:
    """id, piece (from 0), start (the document's ids before it), length, ids (little-endian unsigned 32-bit) of every piece.

    Null and empty texts are the ending id alone. Null ids stay null, repeated rows are documents of their own."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(shared.value)
        for batch in slices(batches, "text"):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(model.encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    for column, value in zip(out, (doc, k, a, b - a, ids[a:b].tobytes()), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids binary")


# --- the plan, on the driver: bounded by the capacity ---------------------------------------------------------------

@dataclass
class Plan:
    """Runs, ordered by (length, rank): ``count`` pieces of ``length`` from ``rank`` on go, ``each`` to a sequence, to the
    sequences from ``sequence`` on, the first of each at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, [(length, count)] from long to short) of groups of equal cardinality; groups of one size are one."""
    total, out, filled = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = filled * groups // total
            upto = -(-(k + 1) * total // groups)
            take = min(left, upto - filled)
            if not out or out[-1][0] != k:
                out.append((k, length, []))
            out[-1][2].append((length, take))
            filled, left = filled + take, left - take
    merged: dict[int, list] = {}
    for _, size, runs in out:
        merged.setdefault(size, []).extend(runs)
    return list(merged.items())


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size fill ``capacity`` to the greatest worth."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    fits = np.searchsorted(sizes[order], np.arange(capacity + 1), "right")
    ordered, value = sizes[order], worth[order]
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            sums = best[room - ordered[: fits[room]]] + value[: fits[room]]
            k = int(sums.argmax())
            if sums[k] > best[room] + 1e-12:
                best[room], took[room] = sums[k], order[k]
    out, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            out[took[room]] += 1
            room -= sizes[took[room]]
    return out


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns (how many of each size) and how often each, of a least fractional packing; Gilmore and Gomory's columns."""
    basis = np.diag(np.floor(capacity / sizes))
    often = demand / np.diag(basis)
    for _ in range(60 * len(sizes)):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = _knapsack(sizes, worth, capacity)
        if column @ worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(change > 1e-9, np.maximum(often, 0) / change, np.inf)
        out = int(ratio.argmin())
        often = often - ratio[out] * change
        often[out] = ratio[out]
        basis[:, out] = column
    return basis, np.maximum(often, 0)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> Plan:
    """Of pieces of 1 to ``capacity`` tokens, counted by length."""
    return min((_plan(histogram, capacity, groups, share) for share in small), key=lambda p: p.sequences)


def _plan(histogram: dict[int, int], capacity: int, groups: int, small: float) -> Plan:
    counts = {k: n for k, n in histogram.items() if n}
    if any(not 1 <= k <= capacity for k in counts):
        raise ValueError(f"lengths from 1 to {capacity} are needed")
    runs: list[tuple] = []
    rank: dict[int, int] = defaultdict(int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # what is free -> (first sequence, how many)
    opened = 0

    def put(length: int, count: int, each: int, sequence: int, offset: int) -> None:
        runs.append((length, rank[length], each, sequence, offset))
        rank[length] += count

    left = dict(counts)
    large = {k: n for k, n in counts.items() if small * capacity < k < capacity}
    if large:
        packs = grouped(large, groups)
        sizes = np.array([s for s, _ in packs])
        longest = sorted(large, reverse=True)
        columns, often = configurations(sizes, np.array([sum(n for _, n in r) for _, r in packs], float), capacity)
        members = [[k for k, _ in r] for _, r in packs]
        for column, times in zip(columns.T, np.floor(often + 1e-6).astype(int).tolist(), strict=True):
            places = [k for k in np.flatnonzero(column) for _ in range(int(column[k]))]  # long to short
            # sequences that are alike: (first, how many, lengths in them)
            open_now = [(opened, times, ())] if times and places else []
            opened += times if places else 0
            while open_now:
                first, many, held = open_now.pop()
                free_now = capacity - sum(held)
                if len(held) < len(places) - 1:
                    length = next((k for k in members[places[len(held)]] if left[k] and k <= free_now), 0)
                elif len(held) < len(places):  # the last place takes the longest piece that what is really free holds
                    length = next((k for k in longest if left[k] and k <= free_now), 0)
                else:
                    length = 0
                if length:
                    got = min(many, left[length])
                    put(length, got, 1, first, capacity - free_now)
                    left[length] -= got
                    open_now.append((first, got, (*held, length)))
                    if got < many:
                        open_now.append((first + got, many - got, held))
                elif held:
                    if free_now:
                        room[free_now].append((first, many))
                else:
                    room[capacity].append((first, many))
    free = sorted(room)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect_left(free, length)
            if at == len(free):
                many = -(-n // (capacity // length))
                insort(free, capacity)
                room[capacity].append((opened, many))
                opened += many
                continue
            fit = free[at]
            first, many = room[fit].pop()
            if not room[fit]:
                free.pop(at)
            each = fit // length
            full = min(many, n // each)
            parts = [(first, full, each)] if full else []
            if full < many and n - full * each:
                if n - full * each < each:
                    parts.append((first + full, 1, n - full * each))
            used = sum(p[1] for p in parts)
            if used < many:
                _free(room, free, fit, first + used, many - used)
            for start, sequences, per in parts:
                put(length, sequences * per, per, start, capacity - fit)
                n -= sequences * per
                if fit - per * length:
                    _free(room, free, fit - per * length, start, sequences)
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    return Plan(*table.T.copy(), opened - sum(n for _, n in room[capacity]))


def _free(room: dict, free: list[int], size: int, first: int, many: int) -> None:
    if not room[size]:
        insort(free, size)
    room[size].append((first, many))


# --- the pieces, in Spark -------------------------------------------------------------------------------------------

def pack(rows: DataFrame, length_col: str = "length", capacity: int = CAPACITY, groups: int = GROUPS, small: tuple[float, ...] = SMALL) -> DataFrame:
    """All columns of ``rows`` with sequence_id and offset: no sequence holds more than ``capacity``, pieces in a sequence
    follow each other without gaps from offset 0.

    Columns of those names are replaced. Rows whose length is null or below 1 get null for both; a length above the
    capacity is a ValueError. Which of the pieces of one length goes where is arbitrary, but the same for repeated runs
    over one written table. An empty table gives an empty result."""
    spark = rows.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/packing-{uuid.uuid4().hex}"
    rows = rows.drop("sequence_id", "offset")
    own = T.StructType([T.StructField("row", rows.schema), T.StructField("size", T.LongType()), T.StructField("task", T.IntegerType()), T.StructField("place", T.LongType())])
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{length_col}`").cast("long").alias("size"))
    packed.mapInArrow(_placed(capacity), own).write.parquet(f"{folder}/placed")
    placed = spark.read.schema(own).parquet(f"{folder}/placed")
    counts = placed.where("size >= 1").groupBy("task", "size").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("task", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    made = plan({r.size: r.n for r in counts.groupBy("size").agg(F.sum("n").alias("n")).toLocalIterator()}, capacity, groups, small)
    shared = spark.sparkContext.broadcast(made)
    numbered = placed.join(starts, ["task", "size"], "left").select("row", "size", (F.col("base") + F.col("place")).alias("rank"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        keys = (p.length << 48) + p.rank
        for batch in batches:
            size, rank = (batch.column(c).to_pandas() for c in ("size", "rank"))
            none = (size.isna() | rank.isna()).to_numpy()
            size, rank = size.fillna(0).to_numpy(np.int64), rank.fillna(0).to_numpy(np.int64)
            at = np.maximum(np.searchsorted(keys, (size << 48) + rank, "right") - 1, 0)
            if len(keys):
                k = rank - p.rank[at]
                sequence, offset = p.sequence[at] + k // p.each[at], p.offset[at] + k % p.each[at] * size
            else:
                sequence = offset = np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence, mask=none), pa.array(offset, mask=none)], names=["row", "sequence_id", "offset"])

    out = T.StructType([own["row"], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(look_up, out).select("row.*", "sequence_id", "offset")


def _placed(capacity: int):
    """Each row's place among the rows of its length in the same task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            size = batch.column("size").to_pandas().fillna(0).to_numpy(np.int64)
            if len(size) and size.max() > capacity:
                raise ValueError(f"a length of {size.max()} is above the capacity of {capacity}")
            size = np.maximum(size, 0)
            order = np.argsort(size, kind="stable")
            ordered = size[order]
            first = np.searchsorted(ordered, ordered)
            place = np.empty(len(size), np.int64)
            place[order] = seen[ordered] + np.arange(len(size)) - first
            seen += np.bincount(size, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("size"), pa.array(np.full(len(size), task), pa.int32()), pa.array(place)], names=["row", "size", "task", "place"])
    return run
