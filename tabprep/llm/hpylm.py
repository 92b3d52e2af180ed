"""Hierarchical Pitman-Yor language model over words (operator 4).

Tokens are words and one end per text. Each context (the token before, by its
64-bit hash) is a restaurant, all of which share one parent, the restaurant of
single words, whose base is uniform over the known words and one
unknown class. In a context a customer is a training token; each of its tables
sends one customer to the parent.

Seating is kept as customers and tables of every dish. A Gibbs sweep takes all
customers of a dish out (a table goes with its last one) and seats them again, at
a table of the dish or at a new one. A sweep does so for every dish of every
restaurant at once, given the restaurants' totals of the sweep before. Totals of
contexts stay in Spark: a range of words sends each range of the context space
its contexts once, then in every sweep their numbers alone, in the same order, and
gets back the sums over all ranges. A sweep starts from the seats that the last one
kept; the scores draw all sweeps once more, each from its own seed. The driver sees
a fixed number of other totals. After the burn-in each sweep gives a predictive distribution, and scores use their mean.

Work is split by word: a range of the word-hash space holds a word's tokens of
all contexts. Chunks of texts send a range each (word, context) once with its
count, so that a frequent pair is one entry per chunk, and words above a share
of a sample's tokens are spread by context, their parent seating being part of
the totals. Every count is over all training texts. The range answers a chunk
with one number for each of its keys, and the chunk adds them up per text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.exchange import CHUNK_WORDS, chunk_name, edges, groups, ranges_for
from tabprep.llm.words import SPACE, Words, mix, pack, ragged, slices, unpack
from tabprep.session import cut_in_place, cut_lineage, release

#: The hashes of the end of a text and of what stands before its first word.
END, START = np.uint64(0xA5A5_1234_9876_0001), np.uint64(0x5A5A_4321_6789_0003)
#: Rows of each task in the sample that picks the words to spread, and how many at most; results don't depend on them.
SAMPLE_ROWS, SPREAD_WORDS = 500, 2048
#: Tokens of a chunk, about: the larger, the fewer words and contexts are sent twice.
CHUNK_TOKENS = 2 * CHUNK_WORDS
#: Customers of a dish up to which the chance that one sits alone is exact.
EXACT = 256
#: Groups in which the customers of larger dishes are reseated, and how often a sweep does so.
GROUPS, PASSES = 16, 4
#: Chances that are held at once.
DRAWN = 1 << 18
#: What a range is told beside the contexts' tables after each sweep.
TOKENS, STATE = -1, -2


@dataclass
class Model:
    """What all ranges share: a fixed number of totals, whatever the corpus."""

    parts: int
    spread: np.ndarray  # words split over all ranges, sorted
    tokens: int = 0  # training tokens
    vocabulary: int = 0
    discount: float = 0.75  # of contexts
    first_discount: float = 0.75  # of the parent in the first sweep
    parent_discount: float = 0.75
    strength: float = 1.0
    spread_tokens: np.ndarray | None = None  # training tokens of each spread word
    parent: list = field(default_factory=list)  # for each sweep: customers and tables of the parent
    spread_seats: list = field(default_factory=list)  # for each sweep: parent customers and tables of each spread word


def stirling(discount: float, _known: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """log S(n, k) of the generalised Stirling numbers up to EXACT customers, and S(n-1, k-1) / S(n, k)."""
    if discount not in _known:
        s = np.full((EXACT + 1, EXACT + 1), -np.inf)
        s[0, 0] = 0.0
        k = np.arange(EXACT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            for n in range(EXACT):
                s[n + 1, 1:] = np.logaddexp(s[n, :-1], s[n, 1:] + np.log(np.maximum(n - discount * k[1:], 1e-300)))
            ratio = np.zeros_like(s)
            ratio[1:, 1:] = np.exp(s[:-1, :-1] - s[1:, 1:])
        _known.clear()
        _known[discount] = s, np.nan_to_num(ratio, nan=0.0)
    return _known[discount]


def alone(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Chance that one of ``c`` customers at ``t`` tables sits alone: S(c-1, t-1) / S(c, t) with generalised
    Stirling numbers up to EXACT customers; beyond, that of EXACT customers at as large a share of tables."""
    few = c <= EXACT
    out = np.interp((t - 1) / np.maximum(c - 1, 1), np.arange(EXACT) / (EXACT - 1), stirling(discount)[1][EXACT, 1:])
    out[few] = stirling(discount)[1][c[few], np.minimum(t[few], EXACT)]
    return out


def seat(c: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """First seating: tables of each dish after its ``c`` customers came in groups that grow by a tenth.
    weight: (strength + discount * tables of the restaurant) * the parent's chance of the dish."""
    t = np.minimum(c, 1).astype(np.int64)
    seated, left = t.copy(), np.flatnonzero(c > 1)
    while len(left):
        come = np.minimum(c[left] - seated[left], np.maximum(1, seated[left] // 10))
        w = weight[left]
        new = rng.binomial(come, w / (w + seated[left] - discount * t[left]))
        t[left] += new
        seated[left] += come
        left = left[seated[left] < c[left]]
    return t


def draw(c: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes of 1 to EXACT customers, all of them seated anew: P(t) is proportional to S(c, t) * weight**t."""
    log_s, t = stirling(discount)[0], np.ones(len(c), np.int64)
    by_size = np.argsort(c, kind="stable")
    at, size = groups(c[by_size])
    for lo, many, n in zip(at.tolist(), size.tolist(), c[by_size[at]].tolist(), strict=True):
        if n < 2:
            continue
        rows, k = by_size[lo : lo + many], np.arange(1, n + 1)
        for lo in range(0, len(rows), max(1, DRAWN // n)):
            some = rows[lo : lo + max(1, DRAWN // n)]
            p = log_s[n, 1 : n + 1] + np.log(weight[some])[:, None] * k
            p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
            t[some] = 1 + (p < rng.random(len(some))[:, None] * p[:, -1:]).sum(axis=1)
    return t


def sweep(c: np.ndarray, t: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """All customers of each dish leave and sit down again: up to EXACT of them at once, from the exact distribution;
    of larger dishes a GROUPSth at a time, PASSES times over, tables counted anew after each group."""
    out = t.copy()
    few = np.flatnonzero((c > 1) & (c <= EXACT))
    out[few] = draw(c[few], weight[few], discount, rng)
    many = np.flatnonzero(c > EXACT)
    c, now, w = c[many], t[many], weight[many]
    size = -(-c // GROUPS)
    for _ in range(GROUPS * PASSES if len(many) else 0):
        now = np.clip(now - rng.binomial(size, alone(c, now, discount)), 1, c - size)
        now = now + rng.binomial(size, w / (w + c - size - discount * now))
    out[many] = now
    return out


def squeeze(values: np.ndarray) -> bytes:
    """Integers that are mostly small: as many bytes as the largest needs, place by place, compressed."""
    v = np.asarray(values).astype(np.uint64)
    width = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    return bytes([width]) + zlib.compress(np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def expand(blob: bytes) -> np.ndarray:
    """What ``squeeze`` was given."""
    places = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros((places.shape[1], 8), np.uint8)
    out[:, : blob[0]] = places.T
    return out.view(np.int64).ravel()


def climb(values: np.ndarray, runs: np.ndarray) -> bytes:
    """Values that ascend within runs of the given lengths: a run's first value, then its steps, which are small."""
    steps, at = np.diff(values, prepend=0), np.cumsum(runs) - runs
    steps[at] = values[at]
    return squeeze(steps)


def climbed(blob: bytes, runs: np.ndarray) -> np.ndarray:
    """What ``climb`` was given."""
    steps, at = expand(blob), np.cumsum(runs) - runs
    total = np.cumsum(steps)
    return total - np.repeat(total[at] - steps[at], runs)


class Range:
    """The training counts of a range's words and pairs, and their seating."""

    def __init__(self, number: int, lines: pd.DataFrame, told: pd.DataFrame | None = None):
        """The line of ``lines`` that is of no chunk: distinct sorted words, contexts that each was seen in, those contexts as places among the sorted ``names``,
        training tokens of each pair. ``told``: over all ranges, customers of each context (sweep TOKENS) and its tables
        after sweeps; the range's own seats (sweep STATE): tables of each pair, of each word in the parent."""
        own = lines[lines.chunk < 0].iloc[0]
        self.number, self.words, self.n = number, unpack(own.words), expand(own.runs)
        self.context, self.count = climbed(own.contexts, self.n), expand(own["counts"])
        self.names = unpack(own.names)
        heard = {} if told is None else {int(x.sweep): x for x in told.itertuples()}
        state = heard.pop(STATE, None)
        self.seats = (None, None) if state is None else (expand(state.a), expand(state.b))
        self.tables = {k: expand(x.a) for k, x in heard.items()}
        self.context_tokens = self.tables.pop(TOKENS, None)
        self.at = np.cumsum(self.n) - self.n
        self.of = np.repeat(np.arange(len(self.n)), self.n)

    def spread(self, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """Which words are spread ones, and their index."""
        return among(self.words, m.spread)

    def add(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.at) if len(self.at) else np.zeros(0, np.int64)

    def sweep(self, m: Model, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Seats all customers anew in sweep ``k``, given the totals and the seats after the one before; customers and
        tables of each word in the parent. Its draws depend on the range and the sweep alone."""
        rng = np.random.default_rng([20240817, self.number, k])
        tables, parent = self.seats
        if k:
            chance = self.chances(m, k - 1, self.add(tables), parent)
            busy = m.strength + m.discount * self.tables[k - 1]
        else:
            spread, index = self.spread(m)
            own = np.where(spread, m.spread_tokens[index] if len(m.spread) else 0, self.add(self.count))
            chance = (own + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1))
            busy = m.strength + m.discount * first_tables(self.context_tokens, m.discount)
        weight = busy[self.context] * chance[self.of]
        tables = sweep(self.count, seat(self.count, weight, m.discount, rng) if tables is None else tables, weight, m.discount, rng)
        customers = self.add(tables)
        discount = m.parent_discount if k else m.first_discount
        flat = np.full(len(customers), (m.strength + discount * (m.parent[k - 1][1] if k else m.vocabulary)) / (m.vocabulary + 1))
        parent = seat(customers, flat, discount, rng) if parent is None else parent
        parent = np.minimum(np.maximum(parent, customers > 0), customers)
        parent = sweep(customers, parent, flat, discount, rng)
        self.seats = tables, parent
        return customers, parent

    def chances(self, m: Model, k: int, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's chance of each word after sweep ``k``."""
        spread, index = self.spread(m)
        if len(m.spread):
            customers = np.where(spread, m.spread_seats[k][0][index], customers)
            tables = np.where(spread, m.spread_seats[k][1][index], tables)
        total, all_tables = m.parent[k]
        rest = (m.strength + m.parent_discount * all_tables) / (m.vocabulary + 1)
        return (np.maximum(customers - m.parent_discount * tables, 0) + rest) / (m.strength + total)

    def scores(self, m: Model, burn_in: int) -> np.ndarray:
        """log10 of each key's predictive probability, averaged over the sweeps after ``burn_in``."""
        total = np.zeros(len(self.context))
        for k in range(len(self.tables)):
            customers, parent = self.sweep(m, k)
            if k >= burn_in:
                chance = self.chances(m, k, customers, parent)[self.of]
                seated = np.maximum(self.count - m.discount * self.seats[0], 0)
                free = m.strength + m.discount * self.tables[k][self.context]
                total += (seated + free * chance) / (m.strength + self.context_tokens[self.context])
        return np.log10(total / (len(self.tables) - burn_in))


def first_tables(customers: np.ndarray, discount: float) -> np.ndarray:
    """Tables of a context before any were counted."""
    return np.maximum(customers, 0) ** discount


def among(words: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are among the sorted ``some``, and where."""
    i = np.searchsorted(some, words)
    i[i == len(some)] = 0
    return (some[i] == words if len(some) else np.zeros(len(words), bool)), i


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word and context of every token, and the tokens of each row."""
    words = Words(column, SPACE, fold=True)
    count = words.count + 1
    ends = np.cumsum(count) - 1
    token = np.zeros(int(count.sum()), np.uint64)
    is_end = np.zeros(len(token), bool)
    is_end[ends] = True
    token[~is_end], token[is_end] = words.hash, END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - count + 1] = START
    return token, mix(before), count


def held_out(ids: list) -> np.ndarray:
    """Whether crc32 of each id as text leaves 2 when divided by 7; a null id counts as an empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids], bool)


def _spread_words(rows: DataFrame) -> np.ndarray:
    """Words with at least a 2000th of the tokens of a bounded sample of each task: those that could fill a range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in slices(batches, "text"):
            if seen >= SAMPLE_ROWS:  # the rest is only passed over
                continue
            batch = batch.slice(0, SAMPLE_ROWS - seen)
            seen += batch.num_rows
            word, n = np.unique(tokens_of(batch.column("text"))[0], return_counts=True)
            often = n * 4000 >= n.sum()
            yield pa.RecordBatch.from_arrays([pa.array(word[often].view(np.int64)), pa.array(n[often])], names=["w", "n"])

    found = rows.select("text").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(SPREAD_WORDS)
    return np.sort(np.array([r.w for r in found.collect()], np.int64).view(np.uint64))


_PAIRS = "part int, chunk long, words binary, runs binary, contexts binary, counts binary, names binary"
_SENT = _PAIRS + ", other int, ids binary, tokens binary, rows binary, times binary"
_NAMES = [x.split()[0] for x in _SENT.split(", ")]


_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.int32(), *[pa.binary()] * 4]


def _line(part: int, chunk: int, **blobs) -> pa.RecordBatch:
    values = {"part": part, "chunk": chunk, **blobs}
    return pa.RecordBatch.from_arrays([pa.array([values.get(n)], t) for n, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _folded(lines: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(lines, pa.schema(list(zip(_NAMES, _TYPES, strict=True))), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _unfolded(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _each_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column("lines"):
            yield from _unfolded(blob.as_buffer()).to_batches()


def _send(batches: Iterator[pa.RecordBatch], parts: int, spread: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per chunk: its distinct (word, context) pairs with training counts, by range; beside them, under a negative
    part, which rows hold each pair of a range."""
    def flush(sequence: int) -> Iterator[pa.RecordBatch]:
        chunk = chunk_name(sequence)
        token, count = (np.concatenate([k[i] for k in kept]) for i in (1, 2))
        ids = [i for k in kept for i in k[0]]
        out = held_out(ids)
        row = np.repeat(np.arange(len(count)), count)
        words, rank = np.unique(token, return_inverse=True)
        names = mix(np.append(words, START))  # a context is the word before
        before = np.empty_like(rank)
        before[1:] = rank[:-1]
        before[np.cumsum(count) - count] = len(words)
        by_name = np.argsort(names)
        names, place = names[by_name], np.empty_like(by_name)
        place[by_name] = np.arange(len(by_name))
        key = rank * len(names) + place[before]
        if len(words) * len(names) * len(count) < 1 << 63:  # rows ascend within a pair
            key, row = np.divmod(np.sort(key * len(count) + row), len(count))
        else:
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
        at, _ = groups(key)
        train = np.add.reduceat((~out[row]).astype(np.int64), at)
        held = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]))
        times = np.diff(np.append(held, len(key)))
        begin = np.searchsorted(held, at)
        rows_of_pair = np.diff(np.append(begin, len(held)))
        word, context = key[at] // len(names), key[at] % len(names)
        own = words[word]
        own = np.where(among(own, spread)[0], mix(own + names[context]), own)
        part = np.searchsorted(edges(parts, 64), own, "right")
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"]))
        yield _line(-1 - chunk % parts, chunk, ids=sink.getvalue().to_pybytes(), tokens=pack(count))
        by_part = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
        cuts, many = groups(part[by_part])
        for lo, n in zip(cuts.tolist(), many.tolist(), strict=True):
            mine = by_part[lo : lo + n]
            p = int(part[mine[0]])
            first, n = groups(word[mine])
            told, where = _places(context[mine], len(names))
            yield _line(p, chunk, words=pack(words[word[mine][first]], True), runs=squeeze(n), contexts=climb(where, n), counts=squeeze(train[mine]), names=pack(names[told], True))
            pairs = ragged(begin[mine], rows_of_pair[mine])
            yield _line(-1 - chunk % parts, chunk, other=p, counts=squeeze(rows_of_pair[mine]), rows=squeeze(row[held[pairs]]), times=squeeze(times[pairs]))

    kept, size, sequence = [], 0, 0
    for batch in slices(batches, "text"):
        token, _, count = tokens_of(batch.column("text"))
        kept.append((batch.column("id").to_pylist(), token, count))
        size += len(token)
        if size >= CHUNK_TOKENS:
            yield from flush(sequence)
            kept, size, sequence = [], 0, sequence + 1
    if kept:
        yield from flush(sequence)


def _places(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ``values`` below ``n``, and each value's place among them."""
    if len(values) < n // 16:
        return np.unique(values, return_inverse=True)
    some = np.zeros(n, bool)
    some[values] = True
    return np.flatnonzero(some), (np.cumsum(some) - 1)[values]


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """A range's distinct pairs with training counts (chunk -1), and each chunk's pairs as places among them. What chunks
    keep of their rows stays as it is."""
    if rows.part.iloc[0] < 0:
        return rows
    own = [unpack(x) for x in rows.words]
    runs = [expand(x) for x in rows.runs]
    words, rank = np.unique(np.concatenate(own), return_inverse=True)
    told = [unpack(x) for x in rows.names]
    names, place = np.unique(np.concatenate(told), return_inverse=True)
    begin = np.cumsum([0, *[len(x) for x in told]])
    context = np.concatenate([place[b + climbed(x, n)] for b, x, n in zip(begin[:-1], rows.contexts, runs, strict=True)])
    key = np.repeat(rank, np.concatenate(runs)) * len(names) + context
    count = np.concatenate([expand(x) for x in rows.counts])
    order = np.argsort(key, kind="stable")
    key = key[order]
    at, n = groups(key)
    place = np.empty(len(key), np.int64)
    place[order] = np.repeat(np.arange(len(at)), n)
    cuts = np.cumsum([0, *[r.sum() for r in runs]])
    word, context = np.divmod(key[at], len(names))
    runs = groups(word)[1]
    table = pd.DataFrame({"part": [rows.part.iloc[0]], "chunk": [-1], "words": [pack(words, True)], "runs": [squeeze(runs)],
                          "contexts": [climb(context, runs)], "counts": [squeeze(np.add.reduceat(count[order], at))], "names": [pack(names, True)]})
    answers = pd.DataFrame({"part": rows.part, "chunk": rows.chunk, "counts": [squeeze(np.diff(place[a:b], prepend=0)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})
    return pd.concat([table, answers]).reindex(columns=_NAMES)


def _merged(*columns: pd.Series) -> bytes:
    return _folded(_merge(pd.DataFrame(dict(zip(_NAMES, columns, strict=True)))))


_SAID = "name string, i long, n long, part int, a binary, b binary"
_TOLD = "part int, sweep int, a binary, b binary"


def _said(r: Range, m: Model, context: np.ndarray, spread: np.ndarray, scalars: np.ndarray, named: bool = False) -> pd.DataFrame:
    """What a range says: the number of each of its contexts, for each range of contexts (``named``: with their names);
    numbers of the spread words, scalars, and its seats if there are any."""
    at = [0, *np.searchsorted(r.names, edges(m.parts, 64)).tolist(), len(r.names)]
    out = [("context", q, 0, r.number, pack(r.names[lo:hi], True) if named else None, squeeze(context[lo:hi])) for q, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)) if lo < hi]
    if not named:
        out.append(("state", 0, 0, r.number, *map(squeeze, r.seats)))
    for name, values in (("spread", spread), ("scalars", scalars)):
        out += [(name, i, int(values[i]), r.number, None, None) for i in np.flatnonzero(values).tolist()]
    return pd.DataFrame(out, columns=[x.split()[0] for x in _SAID.split(", ")])


def _summed(said: DataFrame, m: Model) -> dict[str, np.ndarray]:
    """The numbers of the spread words and the scalars over all ranges."""
    out = {"spread": np.zeros(len(m.spread), np.int64), "scalars": np.zeros(8, np.int64)}
    for r in said.where("name IN ('spread', 'scalars')").groupBy("name", "i").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.name][r.i] = r.n
    return out


def _first_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """A range of contexts: where each range of words has its contexts among all, and their numbers added up."""
    told = [unpack(x) for x in rows.a]
    place = np.unique(np.concatenate(told), return_inverse=True)[1]
    cuts = np.cumsum([0, *[len(x) for x in told]])
    places = [pack(place[a:b], True) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return _sums(rows, pd.DataFrame({"part": rows.part, "places": places})).merge(pd.DataFrame({"part": rows.part, "places": places}), "left", "part")


def _sums(rows: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
    """A range of contexts: their numbers added up, for each range of words that told them."""
    at = dict(zip(places.part, places.places, strict=True))
    place = [unpack(at[p]).astype(np.int64) for p in rows.part]
    total = np.bincount(np.concatenate(place), np.concatenate([expand(x) for x in rows.b])).astype(np.int64)
    return pd.DataFrame({"part": rows.part, "i": rows.i, "numbers": [squeeze(total[x]) for x in place]})


def _told(sums: DataFrame, sweep: int) -> DataFrame:
    """(part, sweep, numbers of all contexts of a range of words, in their order)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        return pd.DataFrame({"part": rows.part.iloc[:1].to_numpy(), "sweep": sweep, "a": [squeeze(np.concatenate([expand(x) for x in rows.numbers]))], "b": None})

    return cut_lineage(sums.select("part", "i", "numbers").groupBy("part").applyInPandas(run, _TOLD))


def _by_context(r: Range, values: np.ndarray) -> np.ndarray:
    return np.bincount(r.context, values, len(r.names)).astype(np.int64)


def _count(r: Range, m: Model) -> tuple:
    spread, index = r.spread(m)
    own = r.add(r.count)
    hot = np.zeros(len(m.spread), np.int64)
    np.add.at(hot, index[spread], own[spread])
    return (_by_context(r, r.count), hot,
            np.array([own.sum(), ((own > 0) & ~spread).sum(), (r.count == 1).sum(), (r.count == 2).sum(), 0, 0, 0, 0]))


def _seats(r: Range, m: Model, k: int) -> tuple:
    customers, parent = r.sweep(m, k)
    spread, index = r.spread(m)
    hot = np.zeros(len(m.spread), np.int64)
    np.add.at(hot, index[spread], customers[spread])
    customers, parent = customers[~spread], parent[~spread]
    return _by_context(r, r.seats[0]), hot, np.array([customers.sum(), parent.sum(), (parent == 1).sum(), (customers == 1).sum(), (customers == 2).sum(), 0, 0, 0])


def _counting(parts: int, spread: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(parts, spread)
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("lines"), strict=True):
                r = Range(part, _unfolded(blob.as_buffer()).to_pandas())
                yield pa.RecordBatch.from_pandas(_said(r, m, *_count(r, m), named=True), pa.schema(_SAID_TYPES), preserve_index=False)
    return run


_SAID_TYPES = [("name", pa.string()), ("i", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]


def _sweeping(shared, k: int):
    def run(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        r = Range(int(rows.part.iloc[0]), _unfolded(rows.lines.iloc[0]).to_pandas(), told)
        return _said(r, shared.value, *_seats(r, shared.value, k))
    return run


def fit(ranges: DataFrame, parts: int, spread: np.ndarray, sweeps: int) -> tuple[Model, DataFrame]:
    """The totals of every sweep, those of contexts as (part, sweep, numbers). Discounts come from the numbers of dishes with one
    and with two customers."""
    spark = ranges.sparkSession
    m = Model(parts, spread)
    said = cut_lineage(ranges.mapInArrow(_counting(parts, spread), _SAID))
    got = _summed(said, m)
    first = cut_lineage(said.where("name = 'context'").groupBy("i").applyInPandas(_first_sums, "part int, i long, numbers binary, places binary"))
    history = tokens = told = _told(first, TOKENS)
    places = first.select("i", "part", "places")
    release(spark)
    m.spread_tokens = got["spread"]
    m.tokens = int(got["scalars"][0])
    m.vocabulary = int(got["scalars"][1] + (m.spread_tokens > 0).sum())
    one, two = got["scalars"][2:4]
    m.discount = float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95))
    rng = np.random.default_rng(20240817)
    hot = None
    for k in range(sweeps):
        shared = spark.sparkContext.broadcast(m)
        said = cut_lineage(ranges.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(_sweeping(shared, k), _SAID))
        got = _summed(said, m)
        sums = said.where("name = 'context'").groupBy("i").cogroup(places.groupBy("i")).applyInPandas(_sums, "part int, i long, numbers binary")
        newest = _told(sums, k)
        del sums
        release(spark)
        told = tokens.unionByName(newest).unionByName(said.where("name = 'state'").select("part", F.lit(STATE).alias("sweep"), "a", "b"))
        history = history.unionByName(newest)
        customers = got["spread"]
        discount = m.first_discount if k == 0 else m.parent_discount
        flat = np.full(len(customers), (m.strength + discount * (m.parent[-1][1] if k else m.vocabulary)) / (m.vocabulary + 1))
        if k == 0:
            one, two = got["scalars"][3:5]
            m.parent_discount = float(np.clip(one / max(one + 2 * two, 1), 0.05, 0.95))
        hot = seat(customers, flat, discount, rng) if hot is None else np.minimum(np.maximum(hot, customers > 0), customers)
        hot = sweep(customers, hot, flat, discount, rng)
        m.spread_seats.append((customers, hot))
        m.parent.append((int(got["scalars"][0] + customers.sum()), int(got["scalars"][1] + hot.sum())))
    return m, history


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = 4, burn_in: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, vocabulary, base_score, score, perplexity.

    A null text counts as empty (one token, the end); a null id is a training row. Rows with the same id and equal
    texts are rows of their own, learnt from as often as they come. Without training rows every token is unknown. An
    empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts, spread = ranges_for(rows, "text"), _spread_words(rows)
    sent = rows.mapInArrow(lambda b: _send(b, parts, spread), _SENT)
    # a row for each part, which stays where it is: what joins it by part is sent there
    tasks = max(2 * parts, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merge = F.pandas_udf(_merged, "binary")
    merged = cut_in_place(sent.repartition(tasks, "part").groupBy("part").agg(merge(*_NAMES).alias("lines")))
    del sent
    release(docs.sparkSession)
    ranges = merged.where("part >= 0")
    m, totals = fit(ranges, parts, spread, sweeps)
    model = docs.sparkSession.sparkContext.broadcast(m)

    def answer(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        part = int(rows.part.iloc[0])
        lines = _unfolded(rows.lines.iloc[0]).to_pandas()
        r = Range(part, lines, told)
        score = r.scores(model.value, burn_in).astype(np.float32)
        spread, index = r.spread(model.value)
        seen = np.where(spread, model.value.spread_tokens[index] if len(model.value.spread) else 0, r.add(r.count))[r.of]
        out = []
        for one in lines[lines.chunk >= 0].itertuples():
            place = np.cumsum(expand(one.counts))
            run, n = groups(r.of[place])
            out.append((one.chunk, part, score[place].tobytes(), squeeze(n), squeeze(seen[place][run])))
        return pd.DataFrame(out, columns=["chunk", "part", "scores", "runs", "seen"])

    answers = ranges.groupBy("part").cogroup(totals.groupBy("part")).applyInPandas(answer, "chunk long, part int, scores binary, runs binary, seen binary")

    def add_up(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        m = model.value
        head = rows[rows.tokens.notna()].iloc[0]
        count = unpack(head.tokens).astype(np.int64)
        ids = pa.ipc.open_stream(head.ids).read_all().column("id").to_pylist()
        total, base, known = np.zeros(len(count)), np.zeros(len(count)), np.zeros(len(count), np.int64)
        bodies = {int(x.other): x for x in rows[rows.tokens.isna()].itertuples()}
        for one in told.itertuples():
            body = bodies[one.part]
            size = expand(body.counts)
            row, times = expand(body.rows), expand(body.times)
            seen = np.repeat(expand(one.seen).astype(np.float64), expand(one.runs))
            plain = np.repeat(np.log10((seen + 1) / (m.tokens + m.vocabulary + 1)), size)
            own = np.repeat(np.frombuffer(one.scores, np.float32).astype(np.float64), size)
            total += np.bincount(row, own * times, len(count))
            base += np.bincount(row, plain * times, len(count))
            known += np.bincount(row, np.repeat(seen > 0, size) * times, len(count)).astype(np.int64)
        return pd.DataFrame({"id": pd.array(ids, "Int64"), "held_out": held_out(ids), "n_tokens": count, "n_known": known, "train_tokens": m.tokens,
                             "vocabulary": m.vocabulary, "base_score": base, "score": total, "perplexity": 10.0 ** np.minimum(-total / count, 300)})

    chunks = merged.where("part < 0").mapInArrow(_each_line, _SENT).groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return chunks.applyInPandas(add_up, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double, perplexity double")
