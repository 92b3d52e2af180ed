"""Very long words and pages, and columns whose names look like an operator's own."""
import tracemalloc

import math

import numpy as np
import sentencepiece

from tabprep.llm import html, pieces


def test_best_paths_of_a_long_word():
    """Memory follows the word's length."""
    v = pieces.load()
    peak = {}
    for n in (5_000, 40_000):
        word = (b"ab1c" * n)[:n]
        tracemalloc.start()
        found = pieces.nbest(v, [word], 4)
        peak[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == 4 and all(b"".join(v.decoded[p] for p in path) == word for _, path in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)
    assert peak[40_000] < 12 * peak[5_000] and peak[40_000] < 100e6


def test_long_word_round_trip(spark, make_docs):
    rows = [(1, "x7" * 100_000), (2, "a" * 30_000), (3, "日本" * 5_000)]
    back = {r.id: r.text for r in pieces.decode(pieces.encode(make_docs(rows))).collect()}
    assert back == dict(rows)


def test_runs_of_spaces_are_pieces():
    """The model's own segmentation has pieces of several spaces, wherever no letter follows them."""
    v, sp = pieces.load(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in ("the     ", "the \n            \n", "a" + " " * 16):
        segments = pieces.segments_of(v, text)
        ids = pieces.solve(v, np.frombuffer(b"".join(segments), np.uint8), np.array([len(s) for s in segments]))[0]
        assert ids.tolist() == sp.encode(text)


def test_long_segments_are_solved_alike():
    v = pieces.load()
    rng = np.random.default_rng(5)
    for letters in ("abe in", "theré日", "\u2581 x"):
        segment = pieces.SPACE + "".join(rng.choice(list(letters), 30_000)).encode().replace(pieces.SPACE, pieces.LITERAL).replace(b" ", pieces.SPACE)
        ids, count, score, gap = pieces.solve(v, np.frombuffer(segment, np.uint8), np.array([len(segment)]))
        long = pieces.solve_long(v, segment)
        assert long[0].tolist() == ids.tolist() and long[1] == count[0] and math.isclose(long[2], score[0]) and math.isclose(long[3], gap[0], abs_tol=1e-9)


def test_all_paths_come_out(spark, make_docs):
    """Each of the n paths is a segmentation of the text, has its score, and is another one."""
    v = pieces.load()
    rows = [(1, "the cat   sat"), (2, ""), (3, None), (4, "naïve—   \n x " * 40), (5, "ab1c" * 2000), (6, "x")]
    text = dict(rows)
    for r in pieces.encode(make_docs(rows), paths=True).collect():
        if text[r.id] is None:
            assert r.paths == [] and r.ids is None
            continue
        assert len(r.paths) == len(r.scores) and r.paths[0] == r.ids and len({tuple(p) for p in r.paths}) == len(r.paths)
        for path, score in zip(r.paths, r.scores, strict=True):
            assert b"".join(v.decoded[p] for p in path).decode()[1:] == text[r.id]
            assert math.isclose(sum(v.score[p] for p in path), score, rel_tol=1e-9, abs_tol=1e-9)


def test_decoding_keeps_columns_of_any_name(spark):
    v = pieces.load()
    rows = spark.createDataFrame([([v.pieces[b"\xe2\x96\x81the"]], "kept", "also", 3)], "ids array<int>, __ids string, ids_x string, text int")
    assert [tuple(r) for r in pieces.decode(rows).collect()] == [("kept", "also", "the")]


def test_pages_with_many_stray_and_nested_tags(spark):
    model = html.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    text = "Some prose, with commas, that is long enough to be an article of its own. " * 5
    nested = "<article><p>" + "<b>" * 50_000 + text + "</b>" * 50_000 + "</p></article>"
    stray = "<div><i>" + "<p>x</p>" * 10 + "</span>" * 100_000 + f"<article><p>{text}</p></article>"
    for page in (nested, stray):
        assert text.strip() in html.main_text(page, model)[0]


def test_parts_named_by_their_first_word(spark):
    model = html.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    page = ("<body><div class='sidebar-left'><p>Links here</p></div><article><h1>Title</h1><p>Text of it, long enough.</p><div class='ad-slot'>Buy now</div><p>More text.</p>"
            "<div class='comment-list'><p>I like it</p></div></article><div class='comment-body'><p>Me too</p></div></body>")
    assert html.main_text(page, model)[0] == "Title\nText of it, long enough.\nMore text."


def test_extraction_keeps_columns_of_any_name(spark):
    pages = spark.createDataFrame([(1, "<article><p>Hello there</p></article>", "kept", 2)], "page_id long, html string, __html string, n_chars int")
    r = html.extract(pages).first()
    assert (r.page_id, r["__html"], r.text, r.n_chars) == (1, "kept", "Hello there", 11)
