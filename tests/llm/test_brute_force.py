"""Operators against plain versions on small tables with nulls, empty and long texts, ties and repeated rows."""
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import xxhash

from tabprep.llm import decontaminate, hpylm, licenses, pieces, quality, simhash, substrings, tokens, urls
from tabprep.llm.words import pack, unpack

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
MARK = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts():
    r = random.Random(5)
    words = ["the", "of", "Éa", "straße", "MIT", "License", "x1", "—", "a&b", "zu", "n0", "日本"]
    made = [" ".join(r.choice(words) for _ in range(r.randint(0, 160))) for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(70))
    rows = list(enumerate(made))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one"), (104, "one two"), (105, "one\u00a0two\x1fthree")]
    rows += [(200 + i, f"w{i} {passage} tail{i} " + made[i]) for i in range(6)]
    rows += [(300, "De " * 400), (301, "De " * 400), (302, "\n".join(["same line here"] * 9)), (303, "x" * 5000), (7, made[7]), (400, made[3] + " Released under the MIT license. GENERAL public-license")]
    rows += [(500, " ".join(f"q{r.randint(0, 50)}" for _ in range(30_000)))]
    return rows


def test_pack_round_trip():
    for v in ([], [0], [5, 5, 5] * 50, [2**64 - 1, 0], list(range(1000))):
        assert unpack(pack(np.array(v, np.uint64))).tolist() == v
        assert unpack(pack(np.array(sorted(v), np.uint64), True)).tolist() == sorted(v)


def test_quality_statistics(spark, make_docs):
    rows = texts()
    want = collections.Counter()
    for i, t in rows:
        w = SPACE.findall(t or "")
        lines = [x for x in (t or "").split("\n") if SPACE.search(x)]
        c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j + k for j in range(len(w) - 2) if c[tuple(w[j:j + 3])] > 1 for k in range(3)}
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))] += 1
    got = quality.statistics(make_docs(rows)).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_forest_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = {r.id: r for r in quality.assess(docs, labels).collect()}
    marked = [(judged[r.doc_id], r.quality) for r in labels.collect()]
    good = [j.kept for j, q in marked if q == 1 and not j.base_failed]
    bad = [j.kept for j, q in marked if q == 0 and not j.base_failed]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)
    nothing = quality.assess(docs.limit(20), labels.where("false")).collect()
    assert all(r.kept != r.base_failed for r in nothing)


def test_length_histogram(spark):
    lengths = [0, 3, 3, 3, 1500, 1024, 1023, 7, None]
    h = tokens.histogram(spark.createDataFrame([(x,) for x in lengths], "n_tokens long"))
    some = [x for x in lengths if x is not None]
    for r in h.collect():
        assert r.n_docs == some.count(r.n_tokens) and r.truncated_total == sum(min(x, r.n_tokens) for x in some)
        assert r.docs_longer == sum(x > r.n_tokens for x in some) and r.tokens_within == sum(x for x in some if x <= r.n_tokens)
    for r in tokens.at_limits(h, [-1, 0, 5, 1023, 9999]).collect():
        cut = sum(min(x, max(r.limit, 0)) for x in some)
        assert r.limit < 0 or (r.truncated_total, r.docs_whole) == (cut, sum(x <= r.limit for x in some))
    assert tokens.quantile(h, 0.5) == sorted(some)[3]


def test_token_lengths(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "Hello world"), (4, "the " * 9)]
    with open(tokens.RANKS, "rb") as f:
        e = tokens.encoder(f.read(), tokens.PATTERN)
    got = {r.id: r.n_tokens for r in tokens.lengths(make_docs(rows)).collect()}
    assert got == {i: len(e.encode_ordinary(t or "")) for i, t in rows}


def fingerprint(t):
    w = SPACE.findall(low(t))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(prints, distance=3):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in ids:
        for b in ids:
            if bin(prints[a] ^ prints[b]).count("1") <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, make_docs):
    rows = texts() + [(600 + i, " ".join(["de"] * (300 + i) + [f"e{i}"])) for i in range(12)]
    prints = {i: fingerprint(t) for i, t in rows}
    component = reach(prints)
    for r in simhash.near_duplicates(make_docs(rows)).collect():
        assert r.bits % (1 << 64) == prints[r.id] and r.component == component[r.id]


def test_simhash_links_of_random_bits(spark):
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(60)]
    some = {s for x in seeds for s in [x, *(x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))) for _ in range(6))]}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in some]
    got = {frozenset((l.a % (1 << 64), l.b % (1 << 64))) for l in simhash.links(spark.createDataFrame(signed, "bits long")).collect()}
    assert got == {frozenset((a, b)) for a in some for b in some if a != b and bin(a ^ b).count("1") <= 3}


def test_language_model(spark, make_docs):
    rows = texts()
    toks = [(i, SPACE.findall(low(t)) + [None]) for i, t in rows]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in toks if not out(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, out(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for i, t in toks)
    got = hpylm.score(make_docs(rows)).collect()
    assert collections.Counter((r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_language_model_beats_the_base_on_held_out_texts(spark):
    got = [r for r in hpylm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(1)
    c, w, d = np.full(4000, 6), np.full(4000, 0.8), 0.6
    t = hpylm.seat(c, w, d, rng)
    for _ in range(30):
        t = hpylm.sweep(c, t, w, d, rng)
    # exact: P(t) is proportional to S(6, t) * w**t
    s = np.zeros((7, 8))
    s[0, 0] = 1
    for n in range(6):
        for k in range(1, 8):
            s[n + 1, k] = s[n, k - 1] + (n - d * k) * s[n, k]
    p = s[6, 1:7] * 0.8 ** np.arange(1, 7)
    assert np.allclose(np.bincount(t, minlength=7)[1:7] / 4000, p / p.sum(), atol=0.03)


def test_url_filter(spark):
    rows = [(1, "HTTP://www.Bad.example.com:80/en/5.html?b=2&a=1&utm_x=3#f"), (2, "https://bad.example.com/en/5/?a=1&b=2"), (3, None), (4, "nothing"), (5, "http://x.example.net/en/"),
            (6, "http://net"), (7, "http://a.net/x"), (8, "http://example.net?q"), (9, "http://good.example.com/a?x://y/"), (2, "https://bad.example.com/en/5/?a=1&b=2")]
    pages = spark.createDataFrame([(i, u, "c") for i, u in rows], "page_id long, url string, block string")
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/")]
    got = [(r.id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, spark.createDataFrame([("http://m.bad.example.com/en/5?a=1&b=2",), (None,)], "url string"), rules).collect()]
    same = (2, "bad.example.com", "/en/5/", None, "block")
    assert sorted(got, key=str) == sorted([(1, "www.bad.example.com:80", "/en/5.html", None, "block"), same, same, (3, "", "", None, "allow"), (4, "", "", None, "allow"),
                                           (5, "x.example.net", "/en/", "example.net/en/", "allow"), (6, "net", "", None, "allow"), (7, "a.net", "/x", "net/", "block"),
                                           (8, "example.net", "", None, "allow"), (9, "good.example.com", "/a", None, "allow")], key=str)


def test_licenses(spark, make_docs):
    rows = texts() + [(700, "SPDX-License-Identifier: (MIT or Apache-2.0) AND GPL-2.0-only with Classpath-exception-2.0\nmore"), (701, "spdx license identifier: MIT and")]
    got = {r.id: r for r in licenses.scan(make_docs(rows)).collect()}
    for i, t in rows:
        w = MARK.findall(low(t))
        at = [k for p in licenses.BASE_PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word) == (len(w), len(at), min(at, default=None), max(at, default=None))
    assert got[700].labels == "apache,gpl,mit" and not got[700].permissive and got[701].labels == "" and 0 < got[400].score <= 1
    assert licenses.allowed(licenses.parse("GPL-3.0 OR MIT AND ISC")) and not licenses.allowed(licenses.parse("(GPL-3.0 OR MIT) AND AGPL-3.0"))


def test_decontamination(spark, make_docs):
    rows = texts()
    items = [(1, " ".join(f"p{i}" for i in range(5, 45))), (2, None), (3, "one two"), (4, " ".join(["de"] * 40)), (5, "x1 zu n0"), (5, "日本 zu"), (None, "w3 p0 p1"), (6, " ".join(f"z{i}" for i in range(20)))]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = MARK.findall(low(t))
        for k in range(max(1, len(w) - 12)) if w else ():
            windows[tuple(w[k:k + 13])].add(i)
    got = decontaminate.decontaminate(make_docs(rows), bench).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    for i, t in rows:
        w, hit, who = MARK.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    who |= windows[tuple(w[k:k + n])]
        assert (by[i].n_words, by[i].n_hit, by[i].items) == (len(w), len(hit), sorted(str(x) for x in who if x is not None)), i
        assert by[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))


def repeats(rows, n=50):
    first, out = {}, {}
    words = {i: SPACE.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k:k + n]), i)
    for i, w in words.items():
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k:k + n])] < i for j in range(k, k + n)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


def test_substrings(spark, make_docs):
    rows = texts()
    want = repeats(rows)
    got = substrings.remove_repeats(make_docs(rows + [(None, rows[5][1])])).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        if r.id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.id]
            assert hashlib.sha256(" ".join(SPACE.findall(r.text or "")).encode()).hexdigest() == r.kept_sha256


def all_paths(v, segment):
    ends = pieces.lattice(v, segment)

    def to(e):
        return [(0.0, [])] if not e else [(s + w, x + [p]) for a, p, w in ends[e] for s, x in to(a)]
    return sorted(to(len(segment)), key=lambda x: -x[0])


def test_best_paths():
    v = pieces.load()
    for text in ("hello", "thé cat", "日本x", "a▁b", "\n\t  x", "eatiin", "naïve—"):
        segments = pieces.segments_of(v, text)
        size = np.array([len(s) for s in segments])
        _, _, score, gap = pieces.solve(v, np.frombuffer(b"".join(segments), np.uint8), size)
        for s, best, lost in zip(segments, score, gap, strict=True):
            paths = all_paths(v, s)
            assert math.isclose(paths[0][0], best) and (len(paths) == 1 or math.isclose(paths[0][0] - paths[1][0], lost, abs_tol=1e-9))
            assert np.allclose([x for x, _ in pieces.nbest(v, [s], 5)], [x for x, _ in paths[:5]])


def test_encoding_round_trip(spark, make_docs):
    rows = texts()
    v = pieces.load()
    encoded = pieces.encode(make_docs(rows))
    back = {(r.id, r.text_sha256): r for r in pieces.decode(encoded).collect()}
    for i, t in rows:
        sha = None if t is None else hashlib.sha256(t.encode()).hexdigest()
        assert back[i, sha].text == t
        if t and len(t) < 400:
            assert np.allclose(back[i, sha].scores, [s for s, _ in pieces.nbest(v, pieces.segments_of(v, t), 4)])
