"""Quality rules with an isolation forest over rule statistics (operator 1).

Every text gets rule statistics in one pass. Random trees split random features
at random places; a document that few splits set apart from the rest of a tree's
sample is anomalous (its mean path is short). The score from which a document
goes is calibrated on labelled rows.

Each tree grows on TREE_ROWS rows that a hash of the row deals to it, the
method's own subsample, whatever the size of the table. Trees are built by a
group each and their nodes, at most 2 * TREE_ROWS a tree, go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprep.llm.words import MARK, SPACE, Words, covered, mix, rolling, slices
from tabprep.session import cut_lineage

TREES, TREE_ROWS = 128, 256
#: Labelled rows that calibrate the threshold, at most (those with the smallest row hash).
CALIBRATION_ROWS = 200_000
SYMBOLS = b"#*$%&|<>"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_digits"]
FEATURES = ["symbols", "dup_lines", "repeats", "upper", "marks", "digits"]

_CONTINUES = np.arange(256) & 0xC0 == 0x80
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_LETTER = np.array([chr(b).isalpha() if b < 128 else not 0x80 <= b < 0xC0 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_POINT = MARK & ~SPACE & ~np.isin(np.arange(256), list(b".,;:'\"-()?/"))


def _per_row(flags: np.ndarray, row: np.ndarray) -> np.ndarray:
    out, some = np.zeros(len(row) - 1, np.int64), row[1:] > row[:-1]
    if some.any():
        out[some] = np.add.reduceat(flags.view(np.uint8), row[:-1][some], dtype=np.int64)
    return out


def counts(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of every row."""
    words = Words(column)
    raw, row, rows = words.raw, words.row, len(words.count)
    out = {"n_words": words.count}
    in_word = ~SPACE[raw]
    out["word_chars"] = _per_row(in_word & ~_CONTINUES[raw], row)
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_marks", _POINT), ("n_digits", _DIGIT)):
        out[name] = _per_row(table[raw], row)
    # lines that hold a word, told apart by row and content
    breaks = np.flatnonzero(raw == 10)
    start = np.sort(np.concatenate([row[:-1], breaks + 1]))
    start = np.unique(start[start < len(raw)])
    end = np.append(start[1:], len(raw))
    holds = np.concatenate([[0], np.cumsum(in_word)])
    some = holds[end] > holds[start]
    start, end = start[some], end[some]
    end = np.where(raw[end - 1] == 10, end - 1, end) if len(end) else end
    owner = np.searchsorted(row, start, "right") - 1
    out["n_lines"] = np.bincount(owner, minlength=rows)
    text = raw.tobytes()
    out["n_dup_lines"] = np.zeros(rows, np.int64)
    seen: set = set()
    before = -1
    for i, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True):
        if i != before:
            seen, before = set(), i
        line = text[a:b]
        if line in seen:
            out["n_dup_lines"][i] += 1
        else:
            seen.add(line)
    # words in three-word windows that their text holds twice
    at = words.whole(3)
    again = np.zeros(len(words.start), bool)
    if len(at):
        owner = np.repeat(np.arange(rows), words.count)[at]
        key = rolling(words.hash, 3)[at] + mix(owner.astype(np.uint64))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        again = covered(at[order[twice]], 3, len(again))
    out["n_repeat_words"] = _per_row(again, words.first)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (xxhash64 of the text) and COUNTS of every row. Null and empty texts count nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            got = counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *[pa.array(got[n].astype(np.int64)) for n in COUNTS]], names=["id", "digest", *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("digest"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, digest long, " + ", ".join(f"{n} long" for n in COUNTS))


def features(stats: DataFrame) -> list:
    """Shares that don't depend on a text's length, as columns."""
    share = lambda n, of, name: (F.col(n) / F.greatest(F.col(of), F.lit(1))).alias(name)
    return [share("n_symbols", "word_chars", "symbols"), share("n_dup_lines", "n_lines", "dup_lines"), share("n_repeat_words", "n_words", "repeats"),
            share("n_upper", "n_letters", "upper"), share("n_marks", "word_chars", "marks"), share("n_digits", "word_chars", "digits")]


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2) * 1.0)


def grow(rows: np.ndarray, seed: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature or -1, split, left, right, path length at a leaf) of one random tree."""
    rng, limit = np.random.default_rng(seed), int(np.ceil(np.log2(max(len(rows), 2))))
    nodes: list = [None]
    todo = [(0, rows, 0)]
    while todo:
        at, own, depth = todo.pop()
        low, high = (own.min(axis=0), own.max(axis=0)) if len(own) else (np.zeros(1), np.zeros(1))
        varied = np.flatnonzero(high > low)
        if depth >= limit or not len(varied):
            nodes[at] = (-1, 0.0, 0, 0, depth + float(expected_path(len(own))))
            continue
        f = int(rng.choice(varied))
        split = float(rng.uniform(low[f], high[f]))
        left = own[:, f] <= split
        nodes[at] = (f, split, len(nodes), len(nodes) + 1, 0.0)
        todo += [(len(nodes), own[left], depth + 1), (len(nodes) + 1, own[~left], depth + 1)]
        nodes += [None, None]
    return nodes


class Forest:
    """Trees side by side, and the mean path of a tree's sample."""

    def __init__(self, trees: list[list[tuple]], sample: float):
        size = max(map(len, trees))
        shape = (len(trees), size)
        self.feature, self.split = np.full(shape, -1), np.zeros(shape)
        self.child, self.path = np.zeros((2, *shape), np.int64), np.zeros(shape)
        for t, nodes in enumerate(trees):
            for i, (f, split, left, right, path) in enumerate(nodes):
                self.feature[t, i], self.split[t, i], self.child[0, t, i], self.child[1, t, i], self.path[t, i] = f, split, left, right, path
        self.mean = float(expected_path(sample)) or 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """From 0 (deep in every tree) to 1 (alone at once)."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                if (f < 0).all():
                    break
                right = (x[rows, np.maximum(f, 0)] > self.split[t, at]).astype(np.int64)
                at = np.where(f < 0, at, self.child[right, t, at])
            total += self.path[t, at]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.mean)


def base_failed() -> F.Column:
    """The plain rules: fewer than 50 words, or more than half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _above(x: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """By how much each rule's limit is passed."""
    return np.maximum(x - limits, 0.0)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: float = 0.999, cost: float = 5.0) -> tuple[Forest, np.ndarray, float]:
    """The forest, each rule's limit and the score from which a document is anomalous.

    labels: ``id_col`` and quality (1 good, 0 bad; others and null ids or qualities are left out). A rule's limit is
    the share that ``good`` of the good rows stay within; the forest sees by how much a row passes each. The
    threshold best separates bad rows from good ones, a lost good row counting ``cost`` times a missed bad one.
    Without rows of both kinds nothing is anomalous.
    """
    rows = stats.select("id", base_failed().alias("failed"), *features(stats))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).where("id is not null and quality in (0, 1)")
    known = rows.join(marks, "id").orderBy(F.xxhash64("id", *FEATURES), "id", "quality").limit(CALIBRATION_ROWS).toPandas()
    x, bad = known[FEATURES].to_numpy(float), (known.quality == 0).to_numpy()
    if not bad.any() or bad.all():
        return Forest([[(-1, 0.0, 0, 0, 1.0)]], 2), np.zeros(len(FEATURES)), 2.0
    limits = np.quantile(x[~bad], good, axis=0)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows.tree.iloc[0])
        own = rows.sort_values(["dealt", *FEATURES])[FEATURES].to_numpy(float)
        nodes = grow(_above(own, limits), tree)
        return pd.DataFrame([(tree, len(own), i, *n) for i, n in enumerate(nodes)], columns=["tree", "rows", "i", "f", "split", "l", "r", "path"])

    dealt = rows.select(F.xxhash64("id", *FEATURES).alias("h"), *FEATURES).withColumn("tree", F.pmod("h", F.lit(TREES)).cast("int")).withColumn("dealt", F.xxhash64("h"))
    first = Window.partitionBy("tree").orderBy("dealt", *FEATURES)
    chosen = dealt.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= TREE_ROWS).drop("rank", "h")
    nodes = chosen.groupBy("tree").applyInPandas(build, "tree int, rows int, i int, f int, split double, l int, r int, path double").toPandas()
    trees = [[tuple(n) for n in t.sort_values("i")[["f", "split", "l", "r", "path"]].itertuples(index=False)] for _, t in nodes.groupby("tree")]
    forest = Forest(trees, float(nodes.groupby("tree").rows.first().mean()))

    judged = ~known.failed.to_numpy(bool)
    if not (bad & judged).any() or not (~bad & judged).any():
        judged[:] = True
    score, bad = forest.score(_above(x[judged], limits)), bad[judged]
    order = np.argsort(-score, kind="stable")
    score, bad = score[order], bad[order]
    caught, lost = np.cumsum(bad) / bad.sum(), np.cumsum(~bad) / (~bad).sum()
    ends = np.flatnonzero(np.append(score[1:] != score[:-1], True))
    best = ends[np.argmax((caught - cost * lost)[ends])]
    if caught[best] <= cost * lost[best]:
        return forest, limits, 2.0
    return forest, limits, float((score[best] + (score[best + 1] if best + 1 < len(score) else 0.0)) / 2)


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, digest (xxhash64 of the text), COUNTS, base_failed, score (0 to 1), kept.

    Null and empty texts have no words and fail the plain rules. Ties at the threshold go. Rows with the same id are
    judged each by its own text; a label of such an id counts for all of them. Empty tables give empty results.
    """
    stats = cut_lineage(statistics(docs, id_col, text_col))
    forest, limits, threshold = fit(stats, labels, id_col)
    shared = docs.sparkSession.sparkContext.broadcast((forest, limits))

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        trees, limits = shared.value
        return pd.Series(trees.score(_above(np.column_stack([c.to_numpy(float) for c in columns]), limits)))

    judged = stats.withColumn("base_failed", base_failed()).withColumn("score", score(*features(stats)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") < threshold))
