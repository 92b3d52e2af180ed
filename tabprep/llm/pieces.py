"""N-best segmentation into SentencePiece pieces, and decoding (operator 10).

A text with its spaces as piece spaces (U+2581) is a lattice: pieces of the
vocabulary are edges between byte positions, and characters without a piece of
their own go by byte pieces. Of this model's pieces none spans the start of a run of spaces, so that
the lattice splits there into segments (the spaces and the word after them)
that can be scored one by one; of a model with other pieces it doesn't split.

Forward Viterbi scores all distinct segments of a batch at once. They are exact
heuristics for an A-star search from the end of the lattice backwards, which
yields the N best paths of a text. A path that leaves the best one in a segment
loses at least that segment's gap between its two best paths; so the N best
paths of a text leave the best path in the N - 1 segments of smallest gap only,
and the search runs over those.

The vocabulary is a BPE model's, whose scores are merge ranks. By Zipf's law a
piece of rank r gets the log probability -ln(r + 2). Decoding is exact: a
literal U+2581 goes by bytes. The model file is a parameter.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabprep.llm.words import Words, ragged, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "\u2581".encode()
#: Inside the lattice: a literal U+2581, and what cuts it into segments. No UTF-8 text holds these bytes.
LITERAL, CUT = b"\xff\xfd\xfb", b"\xfe"
IS_CUT = np.arange(256) == CUT[0]
SLOTS = 1 << 19
#: Segments that a worker remembers, over its tasks, before it starts anew (some 20 MB), and bytes of text at once.
REMEMBERED, AT_ONCE = 200_000, 1 << 19
#: Bytes of new segments that are solved at once; longer segments than LONG go one by one, WINDOW bytes of lattice at a time.
SOLVED, LONG, WINDOW = 1 << 17, 1 << 11, 1 << 14
_memory: dict = {}
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces by id, their scores, and a hash table of pieces and their beginnings: a few MB, sent to every task."""

    pieces: dict  # id of the bytes of each piece
    decoded: list  # bytes that each id stands for
    score: np.ndarray
    byte: np.ndarray  # id of the piece of each lattice byte
    slot_hash: np.ndarray
    slot_id: np.ndarray  # -1: only the beginning of a piece
    slot_more: np.ndarray  # whether a longer piece begins so
    newline_alone: bool
    spaces_lead: bool  # whether all pieces have their spaces in front
    longest: int  # bytes of the longest piece


def _step(h, byte):
    """The hash of a byte string from that of all but its last byte."""
    h = (h ^ byte) * _MULTIPLY
    return h ^ (h >> np.uint64(29))


def load(model_file: str = MODEL) -> Vocabulary:
    """Of a SentencePiece model with byte pieces. Only control, unknown and unused pieces are left out, which stand for no
    text. Runs of spaces are pieces of lowest rank: their merges come last."""
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    n = sp.get_piece_size()
    score, byte, decoded, pieces = np.full(n, -np.log(n + 2.0) - 5.0), np.zeros(256, np.int32), [b""] * n, {}
    for i in range(n):
        if sp.is_byte(i):
            value = int(sp.id_to_piece(i)[3:5], 16)
            byte[value], decoded[i] = i, bytes([value])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            own = sp.id_to_piece(i).encode()
            decoded[i] = own.replace(SPACE, b" ")
            pieces[own] = i
            score[i] = -np.log(2.0 + min(n, -sp.get_score(i)))
    for literal, real in zip(LITERAL, SPACE, strict=True):
        byte[literal] = byte[real]
    begins: dict[bytes, bool] = {}
    for p in pieces:
        for k in range(1, len(p) + 1):
            begins[p[:k]] = begins.get(p[:k], False) or k < len(p)
    slots = (np.zeros(SLOTS, np.uint64), np.full(SLOTS, -2, np.int32), np.zeros(SLOTS, bool))
    with np.errstate(over="ignore"):
        for p, more in begins.items():
            h = np.uint64(0)
            for b in p:
                h = _step(h, np.uint64(b))
            at = int(h) & (SLOTS - 1)
            while slots[1][at] != -2:
                at = (at + 1) & (SLOTS - 1)
            slots[0][at], slots[1][at], slots[2][at] = h, pieces.get(p, -1), more
    return Vocabulary(pieces, decoded, score, byte, *slots, all(b"\n" not in p for p in pieces),
                      all(SPACE not in p[p.count(SPACE) * len(SPACE) :] and p.startswith(SPACE * p.count(SPACE)) for p in pieces), max(map(len, pieces)))


def _find(v: Vocabulary, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece of each hash (-1: none), and whether a longer piece begins so."""
    at = (h & np.uint64(SLOTS - 1)).astype(np.int64)
    ids, more = np.full(len(h), -1, np.int32), np.zeros(len(h), bool)
    todo = np.arange(len(h))
    while len(todo):
        a = at[todo]
        used = v.slot_id[a] != -2
        found = used & (v.slot_hash[a] == h[todo])
        ids[todo[found]], more[todo[found]] = v.slot_id[a[found]], v.slot_more[a[found]]
        todo = todo[used & ~found]
        at[todo] = (at[todo] + 1) & (SLOTS - 1)
    return ids, more


def edges(v: Vocabulary, raw: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, piece) of the lattices of segments laid end to end; end: where each byte's segment ends."""
    h = np.zeros(len(raw), np.uint64)
    found: list[tuple] = []
    named = np.zeros(len(raw), bool)  # characters that are pieces themselves
    lead = (raw & 0xC0) != 0x80
    starts = np.flatnonzero(lead)
    character = np.diff(np.append(starts, len(raw)))
    size = np.zeros(len(raw), np.int64)
    size[starts] = character
    at, k = starts, 0
    while len(at):
        at = at[at + k < end[at]]
        h[at] = _step(h[at], raw[at + k].astype(np.uint64))
        k += 1
        ids, more = _find(v, h[at])
        hit = ids >= 0
        found.append((at[hit], at[hit] + k, ids[hit]))
        named[at[hit & (size[at] == k)]] = True
        at = at[more]
    bare = starts[~named[starts]]
    places = ragged(bare, size[bare])
    found.append((places, places + 1, v.byte[raw[places]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _in_order(step: np.ndarray) -> np.ndarray:
    """A stable order by small integers (sorted digit by digit where they fit)."""
    return np.argsort(step.astype(np.uint16) if len(step) and step.max() < 1 << 16 else step, kind="stable")


def solve(v: Vocabulary, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of segments (bytes end to end, and the bytes of each): pieces of their best paths one after the other, how many
    each has, its score, and by how much the second-best path is worse (inf: there is none). Of equal paths the one
    with the longer last piece is best."""
    begin, segments = np.cumsum(size) - size, len(size)
    owner = np.repeat(np.arange(segments), size)
    frm, to, piece = edges(v, raw, (begin + size)[owner])
    order = np.argsort(to * 64 + (63 - np.minimum(to - frm, 63)))
    order = order[_in_order((to - begin[owner[frm]])[order])]
    frm, to, piece = frm[order], to[order], piece[order]
    seg = owner[frm]
    step, w = to - begin[seg], v.score[piece]
    frm, to = frm + seg, to + seg  # nodes: one more than bytes in every segment
    source, sink = begin + np.arange(segments), begin + np.arange(segments) + size
    nodes = len(raw) + segments
    first, second, back = np.full(nodes, -np.inf), np.full(nodes, -np.inf), np.full(nodes, -1)
    first[source] = 0.0
    cuts = np.searchsorted(step, np.arange(1, int(size.max(initial=0)) + 2))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if lo == hi:
            continue
        node, value = to[lo:hi], first[frm[lo:hi]] + w[lo:hi]
        at = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        top = np.maximum.reduceat(value, at)
        equal = np.flatnonzero(value == np.repeat(top, np.diff(np.append(at, hi - lo))))
        best = equal[np.searchsorted(equal, at)]
        first[node[at]], back[node[at]] = top, best + lo
        # the second-best path takes another last edge, or the same one after a second-best path
        after = second[frm[lo:hi][best]] + w[lo:hi][best]
        value[best] = -np.inf
        second[node[at]] = np.maximum(np.maximum.reduceat(value, at), after)
    steps, now, at = [], np.arange(segments), sink.copy()
    while len(now):
        e = back[at[now]]
        steps.append((now, e))
        at[now] = frm[e]
        now = now[at[now] != source[now]]
    who, which = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64),) * 2
    ids, count = piece[which[::-1][np.argsort(who[::-1], kind="stable")]], np.bincount(who, minlength=segments)
    return ids.astype(np.int32), count, first[sink], np.maximum(first[sink] - second[sink], 0.0)


class Ends:
    """The edges that end at each byte place of a long segment, of one window of places at a time."""

    def __init__(self, v: Vocabulary, segment: bytes):
        self.v, self.raw, self.lo, self.hi = v, np.frombuffer(segment, np.uint8), 0, 0

    def _open(self, place: int) -> None:
        """The window of ``place``: its edges begin there or at most a piece before, at the first byte of a character."""
        self.lo = place // WINDOW * WINDOW
        self.hi = self.lo + WINDOW
        begin = max(0, self.lo - self.v.longest - 4)
        while begin and self.raw[begin] & 0xC0 == 0x80:
            begin -= 1
        end = min(len(self.raw), self.hi)
        while end < len(self.raw) and self.raw[end] & 0xC0 == 0x80:
            end += 1
        raw = self.raw[begin:end]
        frm, to, piece = edges(self.v, raw, np.full(len(raw), len(raw)))
        frm, to = frm + begin, to + begin
        own = (to >= self.lo) & (to < self.hi)
        frm, to, piece = frm[own], to[own], piece[own]
        order = np.lexsort((frm, to))
        self.edges = list(zip(frm[order].tolist(), piece[order].tolist(), self.v.score[piece[order]].tolist(), strict=True))
        self.cuts = np.searchsorted(to[order], np.arange(self.lo, self.hi + 1)).tolist()

    def __getitem__(self, place: int) -> list[tuple[int, int, float]]:
        if not self.lo <= place < self.hi:
            self._open(place)
        return self.edges[self.cuts[place - self.lo] : self.cuts[place - self.lo + 1]]


def solve_long(v: Vocabulary, segment: bytes) -> tuple[np.ndarray, int, float, float]:
    """What ``solve`` gives for one segment, place by place: memory is a few numbers a byte."""
    ends, n = Ends(v, segment), len(segment)
    first, second = array("d", [-math.inf]) * (n + 1), array("d", [-math.inf]) * (n + 1)
    back, via = array("q", [-1]) * (n + 1), array("q", [-1]) * (n + 1)
    first[0] = 0.0
    for k in range(1, n + 1):
        top = next_best = -math.inf
        place = piece = -1
        for a, p, w in ends[k]:  # from the longest piece on
            value = first[a] + w
            if value > top:
                next_best, top, place, piece, after = max(top, next_best), value, a, p, second[a] + w
            elif value > next_best:
                next_best = value
        if place >= 0:
            first[k], second[k], back[k], via[k] = top, max(next_best, after), place, piece
    ids, at = [], n
    while at:
        ids.append(via[at])
        at = back[at]
    return np.array(ids[::-1], np.int32), len(ids), first[n], max(first[n] - second[n], 0.0)


def lattice(v: Vocabulary, segment: bytes) -> list[list[tuple[int, int, float]]] | Ends:
    """Of every byte place, the (place before, piece, score) of the edges that end there."""
    if len(segment) > 48:
        return Ends(v, segment)
    out: list[list] = [[] for _ in range(len(segment) + 1)]
    get, at, n = v.pieces.get, 0, len(segment)
    while at < n:
        size = 1
        while at + size < n and segment[at + size] & 0xC0 == 0x80:
            size += 1
        for to in range(at + size, n + 1):
            p = get(segment[at:to])
            if p is not None:
                out[to].append((at, p, float(v.score[p])))
            elif to == at + size:
                for b in range(at, to):
                    p = int(v.byte[segment[b]])
                    out[b + 1].append((b, p, float(v.score[p])))
        at += size
    return out


def nbest(v: Vocabulary, segments: tuple[bytes, ...] | list[bytes], n: int) -> list[tuple[float, list[int]]]:
    """The n best paths through the segments' lattices one after the other, best first; of equal ones, in the order
    of their pieces from the end. A-star from the end: the forward Viterbi score of a place is what remains exactly.

    Every open entry stands for paths of its own, the best of which scores what the entry says; so the n entries of best
    score are all that n paths can come from, and memory stays a few numbers a byte. They are kept in the order of their
    pieces from the end, which the successors of an entry take over in its place."""
    parts, alpha = [], [0.0]
    for s in segments:
        base, ends = len(alpha) - 1, lattice(v, s)
        parts.append((base, ends))
        for k in range(1, len(s) + 1):
            alpha.append(max([alpha[base + a] + w for a, _, w in ends[k]], default=-math.inf))
    open_now = [(-alpha[-1], None, len(alpha) - 1, 0.0)]
    out: list[tuple[float, list[int]]] = []
    while open_now and len(out) < n:
        at = min(range(len(open_now)), key=lambda k: open_now[k][0])
        _, path, place, done = open_now.pop(at)
        if not place:
            found = []
            while path is not None:
                p, path = path
                found.append(p)
            out.append((done, found))
            continue
        base, ends = next((b, e) for b, e in reversed(parts) if b < place)
        more = [(-round(alpha[base + a] + done + w, 9), (p, path), base + a, done + w) for a, p, w in sorted(ends[place - base], key=lambda x: x[1]) if alpha[base + a] > -math.inf]
        open_now[at:at] = more
        room = n - len(out)
        if len(open_now) > room:
            best = sorted(range(len(open_now)), key=lambda k: open_now[k][0])[:room]
            open_now = [open_now[k] for k in sorted(best)]
    return out


def lattice_bytes(v: Vocabulary, text: str) -> bytes:
    """A text's lattice with CUT before every segment: a space in front of the text, and no piece passes a CUT."""
    if not text:
        return b""
    raw = SPACE + text.encode("utf-8", "surrogatepass").replace(SPACE, LITERAL).replace(b" ", SPACE)
    if v.spaces_lead:
        raw = raw.replace(SPACE, CUT + SPACE).replace(SPACE + CUT, SPACE)
    return raw.replace(b"\n", CUT + b"\n" + CUT).replace(CUT + CUT, CUT) if v.newline_alone else raw


def segments_of(v: Vocabulary, text: str) -> list[bytes]:
    return [s for s in lattice_bytes(v, text).split(CUT) if s]


class Solved:
    """Segments that a task has met, by hash, with their best paths."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.keys, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.count, self.score, self.gap = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

    def places(self, words: Words) -> np.ndarray:
        """The number of each segment; new ones are solved together."""
        keys, first, back = np.unique(words.hash, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        number = np.empty(len(keys), np.int64)
        number[known] = self.number[at[known]]
        new = first[~known]
        if len(new):
            number[~known] = len(self.count) + np.arange(len(new))
            got = [(self.ids, self.count, self.score, self.gap), *self._solve(words, new)]
            self.ids, self.count, self.score, self.gap = (np.concatenate(x) for x in zip(*got, strict=True))
            at = np.searchsorted(self.keys, keys[~known])
            self.keys, self.number = np.insert(self.keys, at, keys[~known]), np.insert(self.number, at, number[~known])
        return number[back]

    def _solve(self, words: Words, new: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        size = words.end[new] - words.start[new]
        lo = 0
        while lo < len(new):
            if size[lo] > LONG:
                ids, count, score, gap = solve_long(self.v, words.raw[words.start[new[lo]] : words.end[new[lo]]].tobytes())
                yield ids, np.array([count]), np.array([score]), np.array([gap])
                lo += 1
                continue
            total = np.cumsum(size[lo : lo + SOLVED])
            stop = np.flatnonzero((size[lo : lo + SOLVED] > LONG) | (total > SOLVED))
            hi = lo + (int(stop[0]) if len(stop) else len(total))
            yield solve(self.v, words.raw[ragged(words.start[new[lo:hi]], size[lo:hi])], size[lo:hi])
            lo = hi


_ENCODED = "id long, ids array<int>, n_pieces long, scores array<double>, second array<int>, text_sha256 string"
_PATHS = ", paths array<array<int>>"


def _own_pieces(size: np.ndarray, bytes_of: list[int], path: list[int]) -> list[list[int]]:
    """The pieces of a path through several segments, by segment."""
    out, at = [], 0
    for n in size.tolist():
        begin = at
        while n > 0:
            n -= bytes_of[path[at]]
            at += 1
        out.append(path[begin:at])
    return out


def _whole_path(ids: np.ndarray, at: np.ndarray, near: list[int], instead: list[list[int]]) -> np.ndarray:
    """The best path with other pieces in some segments; at: where the pieces of each segment begin (one more at the end)."""
    parts, done = [], 0
    for j, own in zip(near, instead, strict=True):
        parts += [ids[done : at[j]], np.array(own, np.int32)]
        done = at[j + 1]
    return np.concatenate([*parts, ids[done:]])


def encode(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL, paths: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ids (pieces of the best path), n_pieces, scores (log probabilities of the n best
    paths, fewer if there are fewer, best first), second (pieces of the second-best path where it differs: the whole
    segments), text_sha256; with ``paths`` also paths (all pieces of each of the n best paths, in the order of scores).

    A null text has null ids, no scores and a null digest; an empty one no pieces and the one score 0. Whole texts are
    segmented, whatever their length; equal paths are ordered by their pieces from the end. Repeated rows are rows of
    their own; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))
    schema = _ENCODED + (_PATHS if paths else "")
    return _texts(docs, id_col, text_col).mapInArrow(_encoder(shared, n, model_file, paths), schema)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def _encoder(shared, n: int, model_file: str, paths: bool):
    """What ``encode`` does to the batches of a task."""
    names_out = [x.split()[0] for x in (_ENCODED + (_PATHS if paths else "")).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, alternatives = shared.value, {}
        bytes_of = [1] * len(v.decoded)
        for p, i in v.pieces.items():
            bytes_of[i] = len(p)
        for batch in slices(batches, "text", AT_ONCE):
            if (solved := _memory.get(model_file)) is None or len(solved.keys) > REMEMBERED:
                solved = _memory[model_file] = Solved(v)
            if len(alternatives) > REMEMBERED // 100:
                alternatives = {}
            texts = batch.column("text").to_pylist()
            words = Words(pa.array([lattice_bytes(v, t or "") for t in texts], pa.binary()), IS_CUT)
            place = solved.places(words)
            starts = np.cumsum(solved.count) - solved.count
            ids = solved.ids[ragged(starts[place], solved.count[place])]
            pieces = np.concatenate([[0], np.cumsum(solved.count[place])])[words.first]
            gap, score = solved.gap[place], solved.score[place]
            scores, second, every = [], [], []
            ends = np.concatenate([[0], np.cumsum(solved.count[place])])
            for i, text in enumerate(texts):
                lo, hi = int(words.first[i]), int(words.first[i + 1])
                if text is None or lo == hi:
                    scores.append([] if text is None else [0.0])
                    second.append(None)
                    every.append([] if text is None else [[]])
                    continue
                own = gap[lo:hi]
                near = np.arange(hi - lo)
                if n - 1 < hi - lo:  # ties at the edge go to the earlier segment
                    edge = np.partition(own, n - 2)[n - 2] if n > 1 else -1.0
                    sure = np.flatnonzero(own < edge)
                    near = np.sort(np.concatenate([sure, np.flatnonzero(own == edge)[: n - 1 - len(sure)]]))
                near = near[np.isfinite(own[near])] + lo
                names = tuple(words.raw[words.start[j] : words.end[j]].tobytes() for j in near)
                if names not in alternatives:
                    alternatives[names] = nbest(v, names, n)
                found = alternatives[names]
                total = float(score[lo:hi].sum())
                scores.append([total + s - found[0][0] for s, _ in found])
                second.append(found[1][1] if len(found) > 1 else None)
                if paths:
                    best, size = ids[ends[lo] : ends[hi]], words.end[near] - words.start[near]
                    every.append([best, *[_whole_path(best, ends[lo : hi + 1] - ends[lo], (near - lo).tolist(), _own_pieces(size, bytes_of, p)) for _, p in found[1:]]])
            gone = np.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(pieces.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array(gone)) if gone.any() else pa.ListArray.from_arrays(pa.array(pieces.astype(np.int32)), pa.array(ids, pa.int32()))
            shas = [None if t is None else hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]
            columns = [batch.column("id"), lists, pa.array(np.diff(pieces)), pa.array(scores, pa.list_(pa.float64())), pa.array(second, pa.list_(pa.int32())), pa.array(shas, pa.string())]
            if paths:
                flat = [p for one in every for p in one]
                inner = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *flat]), pa.int32()))
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, every)]), pa.int32()), inner))
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return run


def decode(encoded: DataFrame, ids_col: str = "ids", model_file: str = MODEL) -> DataFrame:
    """``encoded`` with a column text in place of ``ids_col``: the text that the pieces stand for, without the space in
    front. Null ids give null; bytes that are no UTF-8 (pieces that no text gave) become U+FFFD. A column text of
    ``encoded`` is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(model_file).decoded)
    keep = [c for c in encoded.columns if c not in (ids_col, "text")]
    held = "_".join(["ids", *keep])  # no other column's name
    rows = encoded.select(*[F.col(f"`{c}`") for c in keep], F.col(ids_col).cast("array<int>").alias(held))

    schema = encoded.select(*[F.col(f"`{c}`") for c in keep]).schema.add("text", "string")
    return rows.mapInArrow(lambda batches: _decoded(batches, shared.value), schema)


def _decoded(batches: Iterator[pa.RecordBatch], table: list) -> Iterator[pa.RecordBatch]:
    """Batches with a column text in place of the last one, pieces."""
    size = np.array([len(b) for b in table])
    start, flat = np.cumsum(size) - size, np.frombuffer(b"".join(table), np.uint8)
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            column = part.columns[-1]
            lists = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            count = np.array([len(x) if x.is_valid else 0 for x in column]) if column.null_count else np.diff(np.asarray(column.offsets))
            raw = flat[ragged(start[lists], size[lists])].tobytes()
            ends = np.concatenate([[0], np.cumsum(size[lists])])[np.cumsum([0, *count])].tolist()
            texts = [raw[a:b][1 if raw[a : a + 1] == b" " else 0 :].decode("utf-8", "replace") if ok else None
                     for a, b, ok in zip(ends[:-1], ends[1:], column.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*part.schema.names[:-1], "text"])


def round_trip(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text", model_file: str = MODEL) -> DataFrame:
    """``decode`` of ``encode`` with all paths, both in the same task: the columns of ``encode`` and text, decoded from ids. Pieces
    don't go to Spark and back in between, so that a task holds those of a few texts only."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_file))
    encoder = _encoder(shared, n, model_file, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = (pa.RecordBatch.from_arrays([*b.columns, b.column("ids")], names=[*b.schema.names, "held"]) for b in encoder(batches))
        return _decoded(encoded, shared.value.decoded)

    return _texts(docs, id_col, text_col).mapInArrow(run, _ENCODED + _PATHS + ", text string")
