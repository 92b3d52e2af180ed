"""Prefix trie of conversations with totals of every subtree (operator 13).

A node is a distinct sequence of first d turns (role, text); the root is the
empty sequence. Prefixes are told apart by two 64-bit polynomial hashes, which
come from running sums over rows in the order (conversation, turn), so that no
conversation has to fit into one task. After that a node has an exact name: its
smallest member and its depth.

Totals come by parallel tree contraction. Each round rakes the leaves (their
totals are final and go to their parents) and compresses chains of nodes with
one child: of two neighbours in a chain at most one goes, and its own sum stays
on the edge of its child. A chain loses about half its nodes a round, so the
rounds follow the logarithm of the depth. Contracted nodes are then put back,
last round first, each with its child's total plus what it had itself.

Every round is one written table in the shared folder: a lost executor costs
one round.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.session import ensure_checkpoint_dir

U64 = np.uint64
#: Bases of the two prefix hashes (odd, so that they have inverses) and turns that a conversation takes from its base at most.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SHARED_MOST = 3
#: Conversations whose numbers travel together on their way to a node's digest.
RUN = 512


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2**64; negative exponents go by the inverse."""
    e = np.asarray(exponents, np.int64)
    out = np.ones(len(e), U64)
    for sign, b in ((1, base), (-1, pow(base, -1, 1 << 64))):
        left = np.maximum(sign * e, 0)
        while left.any():
            out = np.where(left & 1, out * U64(b), out)
            left, b = left >> 1, b * b % (1 << 64)
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (conv_id, d1, d2, words) with their place in the conversation and prefix hashes, both counted from
    the task's first row of it."""
    task = TaskContext.get().partitionId()
    conv, count, sums = None, 0, [U64(0), U64(0)]
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("conv_id").to_numpy()
        begins = np.concatenate([[True], ids[1:] != ids[:-1]])
        first = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        carried = (group == 0) & (conv is not None and ids[0] == conv)
        place = np.arange(len(ids)) - first[group] + 1 + np.where(carried, count, 0)
        out = []
        for lane, base in enumerate(BASES):
            terms = batch.column(f"d{lane + 1}").to_numpy().view(U64) * _powers(base, place)
            total = np.cumsum(terms, dtype=U64)
            before = np.concatenate([np.zeros(1, U64), total])[first][group]
            out.append(total - before + np.where(carried, sums[lane], U64(0)))
        conv, count, sums = ids[-1], int(place[-1]), [out[0][-1], out[1][-1]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(ids), task), pa.int32()), batch.column("conv_id"), pa.array(place, pa.int64()),
             *[pa.array(x.view(np.int64)) for x in out], *[batch.column(f"d{k}") for k in (1, 2)], batch.column("words")],
            names=["task", "conv_id", "place", "p1", "p2", "d1", "d2", "words"])


def _carried(numbered: DataFrame) -> dict[int, tuple[int, int, tuple[int, int]]]:
    """For each task whose first conversation began in an earlier one: its id, and the rows and hashes before the task.
    One row a task reaches the driver."""
    ends = numbered.groupBy("task").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", "p1", "p2")).alias("last")).collect()
    out: dict = {}
    conv, count, sums = None, 0, (0, 0)
    for r in sorted(ends, key=lambda r: r.task):
        if conv == r.first:
            out[r.task] = (conv, count, sums)
        if r.last.conv_id == conv:
            shift = [pow(b, count, 1 << 64) for b in BASES]
            sums = tuple((s + x * p) % (1 << 64) for s, x, p in zip(sums, shift, (r.last.p1, r.last.p2), strict=True))
            count += r.last.place
        else:
            conv, count, sums = r.last.conv_id, r.last.place, (r.last.p1 % (1 << 64), r.last.p2 % (1 << 64))
    return out


def _prefixes(rows: DataFrame, folder: str) -> DataFrame:
    """(conv_id, place, p1, p2, q1, q2, words) of every turn: its place from 1, the hashes of the turns up to it and before it."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("d1"), F.col("d2")]
    ordered = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("conv_id", "d1", "d2", "words")
    numbered = _kept(ordered.mapInArrow(_number, "task int, conv_id long, place long, p1 long, p2 long, d1 long, d2 long, words long"), f"{folder}/numbered")
    before = numbered.sparkSession.sparkContext.broadcast(_carried(numbered))

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, ids, place = (batch.column(c).to_numpy() for c in ("task", "conv_id", "place"))
            p = [batch.column(c).to_numpy().view(U64) for c in ("p1", "p2")]
            for t in np.unique(task):
                if int(t) in before.value:
                    conv, count, sums = before.value[int(t)]
                    at = (task == t) & (ids == conv)
                    p = [np.where(at, U64(s) + x * U64(pow(b, count, 1 << 64)), x) for x, s, b in zip(p, sums, BASES, strict=True)]
                    place = np.where(at, place + count, place)
            q = [x - batch.column(d).to_numpy().view(U64) * _powers(b, place) for x, d, b in zip(p, ("d1", "d2"), BASES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(place), *[pa.array(x.view(np.int64)) for x in (*p, *q)], batch.column("words")],
                                             names=["conv_id", "place", "p1", "p2", "q1", "q2", "words"])

    return _kept(numbered.mapInArrow(shift, "conv_id long, place long, p1 long, p2 long, q1 long, q2 long, words long"), f"{folder}/prefixes")


def _kept(rows: DataFrame, path: str) -> DataFrame:
    """Written to the shared folder and read again."""
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _shared(conv: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED_MOST + 1)).cast("int")


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own turns behind the turns from the base: depth, the hashes of the node and of its parent."""
    for batch in batches:
        col = {name: batch.column(name).to_numpy() for name in batch.schema.names}
        move = col["taken"] - col["skip"]
        out = {"conv_id": col["conv_id"], "depth": col["place"] + move}
        for lane, base in enumerate(BASES, 1):
            factor = _powers(base, move)
            head, own = col[f"b{lane}"].view(U64), col[f"o{lane}"].view(U64)
            out[f"k{lane}"] = (head + factor * (col[f"p{lane}"].view(U64) - own)).view(np.int64)
            out[f"up{lane}"] = (head + factor * (col[f"q{lane}"].view(U64) - own)).view(np.int64)
        out["words"] = col["words"]
        yield pa.RecordBatch.from_pydict({k: pa.array(out[k], pa.int64()) for k in ("conv_id", "depth", "k1", "k2", "up1", "up2", "words")})


def _rebuilt(prefixes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, k1, k2, up1, up2, words) for every turn of every rebuilt conversation, and (conv_id, depth, k1, k2)
    of every rebuilt conversation's end."""
    head = F.when(F.col("place") <= SHARED_MOST, F.struct("place", "p1", "p2", "q1", "q2", "words"))
    heads = prefixes.groupBy("conv_id").agg(F.sort_array(F.collect_list(head)).alias("own"), F.max(F.struct("place", "p1", "p2")).alias("last"))
    heads = heads.withColumn("skip", _shared(F.col("conv_id")))
    base = heads.select(F.col("conv_id").alias("base_id"), F.col("own").alias("base"))
    convs = heads.join(base, F.col("conv_id") - F.col("conv_id") % 20 == F.col("base_id"), "left")
    convs = convs.withColumn("base", F.slice(F.coalesce("base", F.array().cast(heads.schema["own"].dataType)), F.lit(1), F.col("skip")))
    zero = F.lit(0).cast("long")
    at = F.least("skip", F.size("own"))
    pick = lambda array, n, field: F.when(n > 0, F.element_at(F.col(array), F.greatest(n, F.lit(1))).getField(field)).otherwise(zero)
    convs = _kept(convs.select("conv_id", "skip", F.size("base").alias("taken"), "base", "last", *[pick("base", F.size("base"), f"p{k}").alias(f"b{k}") for k in (1, 2)], *[pick("own", at, f"p{k}").alias(f"o{k}") for k in (1, 2)]), f"{folder}/convs")
    longs = [F.col(c).cast("long").alias(c) for c in ("taken", "skip")]
    columns = "conv_id long, depth long, k1 long, k2 long, up1 long, up2 long, words long"
    info = convs.select(F.col("conv_id").alias("c"), *longs, "b1", "b2", "o1", "o2")
    own = prefixes.join(info, F.col("conv_id") == F.col("c")).where("place > skip").drop("c")
    taken = convs.select("conv_id", F.explode("base").alias("t")).select("conv_id", F.col("t.place").alias("depth"), F.col("t.p1").alias("k1"), F.col("t.p2").alias("k2"), F.col("t.q1").alias("up1"), F.col("t.q2").alias("up2"), F.col("t.words").alias("words"))
    turns = own.mapInArrow(_moved, columns).unionByName(taken)
    ends = convs.select("conv_id", *longs, F.greatest(F.col("last.place"), F.col("skip").cast("long")).alias("place"), F.col("last.place").alias("n"), "last.p1", "last.p2", "b1", "b2", "o1", "o2")
    # a conversation without turns of its own behind the skipped ones ends where the turns from its base do
    ends = ends.select("conv_id", "taken", "skip", "place", *[F.when(F.col("n") > F.col("skip"), F.col(f"p{k}")).otherwise(F.col(f"o{k}")).alias(f"p{k}") for k in (1, 2)], zero.alias("q1"), zero.alias("q2"), "b1", "b2", "o1", "o2", zero.alias("words"))
    return turns, ends.mapInArrow(_moved, columns).select("conv_id", "depth", "k1", "k2")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) rows as comma-joined runs of up to RUN numbers of one node."""
    for batch in batches:
        if not batch.num_rows:
            continue
        depth, k1, k2, conv = (batch.column(c).to_numpy() for c in ("depth", "k1", "k2", "conv_id"))
        cut = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]))
        starts = np.concatenate([np.arange(a, b, RUN) for a, b in zip(cut, np.append(cut[1:], len(conv)), strict=True)])
        names = conv.astype("U").tolist()
        joined = [",".join(names[a:b]) for a, b in zip(starts, np.append(starts[1:], len(conv)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x[starts]) for x in (depth, k1, k2, conv)] + [pa.array(joined)], names=["depth", "k1", "k2", "first", "joined"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node of sorted runs, fed run by run."""
    node, digest = None, None
    for batch in batches:
        done: list[tuple] = []
        for *key, joined in zip(*[batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "joined")], strict=True):
            if key == node:
                digest.update(b"," + joined.encode())
                continue
            if node is not None:
                done.append((*node, digest.hexdigest()))
            node, digest = key, hashlib.sha256(joined.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["depth", "k1", "k2", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], names=["depth", "k1", "k2", "ends_sha256"])


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes at which conversations end. A node's numbers are sorted over ranges, so that a
    hot node is many tasks' work; the digest itself, which is sequential, then reads one joined string per RUN numbers."""
    tasks = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = ["depth", "k1", "k2"]
    runs = ends.repartitionByRange(tasks, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_runs, "depth long, k1 long, k2 long, first long, joined string")
    return runs.repartition(tasks, *key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def subtree_totals(tree: DataFrame, values: list[str]) -> DataFrame:
    """(conv_id, depth) and for each of ``values`` its sum over the node's subtree, itself included.

    tree: conv_id and depth (together a node's name), up_id and up_depth of its parent (null: a root), n_children, and the
    columns ``values`` (long). Any forest will do; an empty one gives an empty result."""
    spark = tree.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"
    state = tree.select("conv_id", "depth", "up_id", "up_depth", F.col("n_children").cast("long").alias("n"), *[F.lit(0).cast("long").alias(f"e_{v}") for v in values], *[F.col(v).cast("long").alias(f"a_{v}") for v in values])
    name, up = ["conv_id", "depth"], ["up_id", "up_depth"]
    rounds = []
    while True:
        here = _kept(_contracted(state, values, len(rounds)), f"{folder}/round-{len(rounds)}")
        rounds.append(here)
        kept, gone = here.where("fate = 0"), here.where("fate = 2")
        if kept.isEmpty():
            break
        # the child of a node that went hangs below the node's parent, with the node's own sum on its edge
        to = gone.select(F.col("child.conv_id").alias("conv_id"), F.col("child.depth").alias("depth"), F.col("up_id").alias("new_id"), F.col("up_depth").alias("new_depth"), F.lit(True).alias("moved"), *[(F.col(f"e_{v}") + F.col(f"a_{v}")).alias(f"m_{v}") for v in values])
        state = kept.drop("fate", "child").join(to, name, "left")
        state = state.select(*name, *[F.when(F.col("moved"), F.col(new)).otherwise(F.col(old)).alias(old) for old, new in zip(up, ("new_id", "new_depth"), strict=True)], "n", *[(F.col(f"e_{v}") + F.coalesce(f"m_{v}", F.lit(0))).alias(f"e_{v}") for v in values], *[f"a_{v}" for v in values])
    totals = None
    for r, here in reversed(list(enumerate(rounds))):
        leaves = here.where("fate = 1").select(*name, *[F.col(f"a_{v}").alias(v) for v in values])
        totals = leaves if totals is None else totals.unionByName(leaves)
        gone = here.where("fate = 2")
        if r < len(rounds) - 1 and not gone.isEmpty():
            below = totals.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), *[F.col(v).alias(f"t_{v}") for v in values])
            back = gone.join(below, (F.col("child.conv_id") == F.col("c")) & (F.col("child.depth") == F.col("d")))
            back = back.select(*name, *[(F.col(f"a_{v}") + F.col(f"child.e_{v}") + F.col(f"t_{v}")).alias(v) for v in values])
            totals = totals.unionByName(_kept(back, f"{folder}/back-{r}"))
    return totals


def _contracted(state: DataFrame, values: list[str], r: int) -> DataFrame:
    """One round: leaves with their final sums (fate 1), nodes taken out of chains with their child (fate 2), and the rest (0)."""
    name, up = ["conv_id", "depth"], ["up_id", "up_depth"]
    leaves = state.where("n = 0")
    raked = leaves.where("up_id is not null").groupBy(*[F.col(u).alias(c) for u, c in zip(up, name, strict=True)]).agg(F.count("*").alias("less"), *[F.sum(F.col(f"a_{v}") + F.col(f"e_{v}")).alias(f"s_{v}") for v in values])
    rest = state.where("n > 0").join(raked, name, "left")
    rest = rest.select(*name, *up, (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), *[f"e_{v}" for v in values], *[(F.col(f"a_{v}") + F.coalesce(f"s_{v}", F.lit(0))).alias(f"a_{v}") for v in values])
    child = F.struct("conv_id", "depth", "n", *[f"e_{v}" for v in values])
    children = rest.where("up_id is not null").groupBy(*[F.col(u).alias(c) for u, c in zip(up, name, strict=True)]).agg(F.max(child).alias("child"))
    joined = rest.join(children, name, "left")
    # of two neighbours in a chain that both want to go only the lower one does
    lone = (F.col("n") == 1) & F.col("up_id").isNotNull() & _wants(F.col("conv_id"), F.col("depth"), r)
    below = (F.col("child.n") == 1) & _wants(F.col("child.conv_id"), F.col("child.depth"), r)
    rest = joined.withColumn("fate", F.when(lone & F.col("child").isNotNull() & ~below, 2).otherwise(0))
    out = [*name, *up, "n", *[f"e_{v}" for v in values], *[f"a_{v}" for v in values]]
    none = F.lit(None).cast(joined.schema["child"].dataType)
    return rest.select(*out, "fate", F.when(F.col("fate") == 2, F.col("child")).alias("child")).unionByName(leaves.select(*out, F.lit(1).alias("fate"), none.alias("child")))


def _wants(conv: Column, depth: Column, r: int) -> Column:
    """Whether a chain's node may go in round ``r``: every second one of a chain that has not been cut yet, later a coin."""
    if r < 12:
        return F.shiftright(depth, r).bitwiseAND(F.lit(1)) == 1
    return F.pmod(F.xxhash64(conv, depth, F.lit(r)), F.lit(2)) == 0


def build(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, n_words (of the node's last text), n_ends (members that end here).

    Rows without a conversation take no part. Turns are ordered by number, null first, then by role and by the hash of
    the text; repeated rows are turns of their own. Null roles and texts are empty. An empty table has no node at all, a
    table in which no conversation has turns left only the root. Other columns are not looked at."""
    spark = conversations.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.xxhash64(role, text).alias("d1"), F.xxhash64(F.lit(1), text, role).alias("d2"), F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words")).where("conv_id is not null")
    turns, ends = _rebuilt(_prefixes(rows, folder), folder)
    key, parent = ["depth", "k1", "k2"], ["up1", "up2"]
    inner = turns.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in parent], F.min("words").alias("n_words"))
    zero = F.lit(0).cast("long")
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", *[F.lit(None).cast("long").alias(c) for c in parent], zero.alias("n_words"))
    nodes = _kept(inner.unionByName(root), f"{folder}/nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")).agg(F.count("*").alias("n_children"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(above, ["depth", *parent], "left").join(children, key, "left").join(_ends(ends), key, "left").join(ends.groupBy(*key).agg(F.count("*").alias("n_ends")), key, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    tree = known.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_words", F.coalesce("n_ends", zero).alias("n_ends"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
    tree = _kept(tree, f"{folder}/tree")
    sums = subtree_totals(tree.select("conv_id", "depth", F.col("parent_conv_id").alias("up_id"), F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_depth"), "n_children",
                                      F.when(F.col("n_children") == 0, 1).otherwise(0).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    return tree.join(sums, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_words", "n_ends")
