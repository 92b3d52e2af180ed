"""The prefix trie against a plain trie, and its contraction against plain sums."""
import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
from pyspark.sql import types as T

from tabprep.llm import queries, trie

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                     T.StructField("depth", T.StringType()), T.StructField("n", T.IntegerType())])


def plain(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])  # -7 % 20 is -7 in SQL
    members = collections.defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].add(c)
    children = collections.Counter(k[:-1] for k in members if k)
    sums = {}
    for k in sorted(members, key=len, reverse=True):
        leaf, saved = sums.get(k, (0, 0))
        leaf += not children[k]
        saved += (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        sums[k] = (leaf, saved)
        if k:
            a, b = sums.get(k[:-1], (0, 0))
            sums[k[:-1]] = (a + leaf, b + saved)
    rows = set()
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if built[c] == k)))
        rows.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def got(spark, rows):
    found = trie.build(spark.createDataFrame([(*r, "x", 7) for r in rows], ROWS)).drop("n_words", "n_ends").collect()
    assert len(found) == len(set(map(tuple, found)))
    return set(map(tuple, found))


def test_trie_of_odd_rows(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["", None, "a b", " a\tb\x0b", "one"])) for c in range(120) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "no conversation"), (500, None, "user", "null turn"), (500, 0, "user", "x"), (-7, 0, "user", "negative"), (10**12, 3, "user", "alone")]
    rows += [(600, 1, "user", "same"), (600, 1, "user", "same"), (600, 1, "assistant", "tie by role")]
    rows += [(700 + i, 0, "user", "w " * 20_000) for i in range(3)]
    assert got(spark, rows) == plain(rows)


def test_trie_with_a_hot_conversation_and_many_copies(spark):
    r = random.Random(4)
    rows = [(41, t, "user", f"turn {t}") for t in range(900)]  # a conversation over all range partitions
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(150) for t in range(5)]
    rows += [(41 + 20 * c, t, "user", f"turn {t}" if t < 300 - c else "other") for c in range(1, 8) for t in range(310)]
    r.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_empty_trie(spark):
    assert got(spark, []) == set()
    assert got(spark, [(None, 1, "user", "x")]) == set()
    for c in range(21, 39):  # a conversation whose turns are all replaced by those of an absent one
        if zlib.crc32(str(c).encode()) % 4:
            assert got(spark, [(c, 0, "user", "x")]) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}
            break


def test_subtree_totals_of_any_forest(spark):
    r = random.Random(5)
    up = {}
    for i in range(1, 800):  # long chains, stars and roots
        up[i] = r.choice([i - 1, i - 1, i - 1, i - 1, r.randrange(i), None])
    n = collections.Counter(p for p in up.values() if p is not None)
    value = {i: r.randint(-5, 9) for i in [0, *up]}
    rows = [(i, i % 5, up.get(i), None if up.get(i) is None else up[i] % 5, n[i], value[i]) for i in value]
    want = dict(value)
    for i in sorted(up, reverse=True):
        if up[i] is not None:
            want[up[i]] += want[i]
    found = trie.subtree_totals(spark.createDataFrame(rows, "conv_id long, depth long, up_id long, up_depth long, n_children long, v long"), ["v"])
    assert {(x.conv_id, x.v) for x in found.collect()} == set(want.items())


def test_trie_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(queries.ORACLE["op13_prefix_trie"]).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(str, want)) == sorted(str(tuple(x)) for x in queries.op13_prefix_trie(spark, sf).select(*names).collect())
