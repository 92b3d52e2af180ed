import html as entities
import math
import re

import test_brute_force as B
from pyspark.sql import functions as F

import corpus_pipeline as C
from tabprep.llm import decontaminate, hpylm, html, licenses, pieces, quality, simhash, substrings, tokens
from tabprep.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("n_chars", F.lit("x"))
    for r in html.extract(pages).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_other_pages(spark):
    model = html.train(spark.read.parquet(f"{SF}/pages.parquet"))
    page = ("<body><div id='cookie-notice'><p>We use cookies</p></div><header><h1>Site</h1></header><div class=sidebar><p>Long text, of a sidebar, in prose. Really.</p></div><main><div class='post'>"
            "<h2>Title &amp; more</h2><p>Hello <b>bold</b>\n  world<script>x</script></p><ul><li>one<li>two</ul><form><label>Mail</label></form><div class='comments'><p>nice</p></div></div></main>"
            "<section id=comments><article class=comment><p>I like it.</p></article></section><footer>c</footer>")
    assert html.main_text(page, model)[0] == "Title & more\nHello bold world\none\ntwo"
    assert html.main_text("", model)[0] == "" and html.main_text("<p", model)[0] == "" and html.main_text("a < b", model)[0] in ("a < b", "")
    plain = "<body><div><p>" + "Plain text here, with commas. " * 9 + "</p></div><div class=ad>Buy</div></body>"
    assert html.main_text(plain, model)[0] == ("Plain text here, with commas. " * 9).strip()


def test_empty_tables(spark, make_docs):
    none = make_docs([])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (quality.assess(none, labels), tokens.histogram(tokens.lengths(none)), simhash.near_duplicates(none), hpylm.score(none), licenses.scan(none),
               decontaminate.decontaminate(none, bench), substrings.remove_repeats(none), pieces.decode(pieces.encode(none))):
        assert df.collect() == []
    assert html.extract(spark.createDataFrame([], "page_id long, html string")).collect() == []


def test_every_operator_is_registered():
    import __spark_entry__ as E
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and len(QUERIES) == 13


def planted(spark, folder):
    """The documents of SF with copies, shared passages and benchmark text of our own, in a folder of tables."""
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    long = [d for d in docs if 150 < len(d[1].split()) < 600]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 20]
    passage = long[3][1].split()[:70]
    made = [(90_000 + i, d[1].upper() if i % 2 else d[1] + " .") for i, d in enumerate(long[:20])]
    made += [(91_000 + i, " ".join(d[1].split()[:120] + passage + d[1].split()[120:])) for i, d in enumerate(long[20:40])]
    made += [(92_000 + i, long[40 + i][1] + " " + t) for i, t in enumerate(items[:10])]
    rows = docs + [(i, t, "en", "planted", len(t)) for i, t in made]
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return {r[0]: r[1] for r in rows}


def without_repeats(texts, n=50):
    """Texts without words of windows that a smaller id holds; what stays whole is unchanged."""
    words = {i: B.SPACE.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k:k + n]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k:k + n])] < i for j in range(k, k + n)}
        if len(gone) < len(w) or not w:
            out[i] = [x for j, x in enumerate(w) if j not in gone] if gone else texts[i]
    return out


def contaminated(text, windows):
    w = B.MARK.findall(B.low(text))
    hit = {j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows for j in range(k, k + n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def best_path(v, text):
    """(score, pieces) of a text's best path by a plain forward pass over each segment."""
    total, count = 0.0, 0
    for segment in pieces.segments_of(v, text):
        ends = pieces.lattice(v, segment)
        best = {0: (0.0, 0)}
        for end in range(1, len(segment) + 1):
            best[end] = max(((best[a][0] + w, best[a][1] + 1) for a, _, w in ends[end] if a in best), key=lambda x: x[0], default=(-math.inf, 0))
        total, count = total + best[len(segment)][0], count + best[len(segment)][1]
    return total, count


def test_pipeline(spark, tmp_path):
    """run() against plain versions of the stages; of the first one the plain rules and the labels are known."""
    texts = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = {r.doc_id for r in C.quality_rules(spark, docs, str(tmp_path)).collect()}
    for i, t in texts.items():
        w = B.SPACE.findall(t or "")
        assert len(w) >= 50 or i not in one
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if len(B.SPACE.findall(texts[r.doc_id] or "")) >= 50}
    assert sum(i in one for i, q in marks.items() if q) > 0.97 * sum(marks.values())
    left = {i: texts[i] for i in one}
    component = B.reach({i: B.fingerprint(t) for i, t in left.items()})
    left = {i: t for i, t in left.items() if component[i] == i}
    assert len(one) - len(left) >= 15
    left = without_repeats(left)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k:k + 13]) for w in (B.MARK.findall(B.low(t)) for t in items) if w for k in range(max(1, len(w) - 12))}
    left = {i: t for i, t in left.items() if not contaminated(t if isinstance(t, str) else " ".join(t), windows)}
    cut = {i: t for i, t in left.items() if not isinstance(t, str)}
    assert any(i // 1000 == 91 for i in cut)
    got = {r.doc_id: r for r in C.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(left) and all(r.exact for r in got.values())
    v = pieces.load()
    decoded = {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame([(i, r.ids) for i, r in got.items()], "doc_id long, ids array<int>")).collect()}
    for i, t in left.items():
        assert (B.SPACE.findall(decoded[i]) if i in cut else decoded[i]) == t
    for i in sorted(left)[::25]:
        score, n = best_path(v, decoded[i])
        assert math.isclose(score, got[i].score, rel_tol=1e-9) and got[i].n_pieces == len(got[i].ids) and abs(n - got[i].n_pieces) <= 2


def test_stages_keep_columns_of_any_name(spark):
    """Names of the stages' own columns clash with none of the table's."""
    names = ["id", "digest", "row", "a", "b", "component", "kept", "__id", "__digest", "__ids", "n_removed", "n_words", "text_sha256"]
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(i, t, *[f"{n} {i}" for n in names]) for i, t in enumerate([long, long + " more", "other " * 3 + " ".join(f"v{i}" for i in range(80)), "x " + long])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{n}` string" for n in names]]))
    for stage in (C.quality_rules, C.near_duplicates, C.substring_dedup, C.benchmark_decontamination):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == f"{n} {r.doc_id}" for n in names)


def test_stages_take_odd_rows(spark, make_docs):
    docs = make_docs([(None, None), (1, "word " * 80), (1, "word " * 80), (2, ""), (None, "other text " * 40)])
    for stage in (C.near_duplicates, C.substring_dedup, C.benchmark_decontamination):
        assert stage(spark, docs, SF).columns == docs.columns
    assert C.near_duplicates(spark, docs, SF).where("doc_id = 1").count() == 1


def test_encoding_gives_all_paths(spark, make_docs):
    """The last stage has the pieces of every path that operator 10 finds, not of the best alone."""
    rows = [(1, "the cat   sat on the mat"), (2, ""), (None, "naïve " * 40), (3, None)]
    want = {r.id: r for r in pieces.encode(make_docs(rows), paths=True).collect()}
    got = {r.doc_id: r for r in C.piece_encoding(spark, make_docs(rows), SF).collect()}
    assert set(got) == set(want)
    for i, w in want.items():
        assert (got[i].ids, got[i].paths, got[i].scores, got[i].n_pieces, got[i].exact) == (w.ids, w.paths, w.scores, w.n_pieces, True)
    assert len(got[1].paths) == 4


def test_near_copies_under_one_id(spark, make_docs):
    """Rows are judged each by its own text, whatever other rows have their id."""
    one, two = (" ".join(f"{c}{i}" for i in range(120)) for c in "uv")
    fresh = " ".join(f"w{i}" for i in range(120))
    docs = [(0, one), (1, one.upper()), (1, two), (1, two.upper()), (2, two), (None, one), (None, fresh), (None, fresh), (4, None), (4, "")]
    got = sorted(((r.doc_id, r.text) for r in C.near_duplicates(spark, make_docs(docs), SF).collect()), key=str)
    assert [r[0] for r in got] == [0, 1, 4, None] and got[0][1] == one and got[1][1] in (two, two.upper()) and got[3][1] == fresh


def test_every_document_goes_through_the_substring_operator(spark, make_docs):
    """All rows come out of operator 9, changed or not, each with its own columns."""
    long = " ".join(f"w{i}" for i in range(90))
    docs = make_docs([(1, long), (2, "a " + long + " b"), (3, long), (None, long), (4, None), (5, ""), (6, "x  y"), (7, long), (7, long + " z")])
    want = {(r.id, r.digest): r for r in substrings.remove_repeats(docs).collect()}
    got = [(r.doc_id, r.text, r.n_words) for r in C.substring_dedup(spark, docs, SF).collect()]
    left = [(r.id, r.text, "x") for r in want.values() if r.n_removed == 0 or r.n_removed < r.n_words]
    assert sorted(got, key=str) == sorted(left, key=str) and len(left) == 7
    assert len(substrings.remove_repeats(docs.withColumn("own", F.col("bits") + 1), keep="own").where("kept = 2").collect()) == docs.count()
