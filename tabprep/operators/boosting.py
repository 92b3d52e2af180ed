"""AdaBoost of stumps for many runs in lock-step (L11, classification).

A search trains the same rounds again and again: for each learning rate, each fold and the whole train set. Here all
runs go side by side. Rows carry one weight for each run; a round is one job that adds up, for every run, the weights by
(feature, bin, class), from which the driver reads each run's best stump. Runs of fewer rounds are prefixes of the longest
one, so that (50, 100, 200) rounds cost 200. Rows are held in chunks as packed arrays, written to the shared folder every
KEEP rounds with their weights; between, the latest stumps are applied again on reading.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabprep.session import ensure_checkpoint_dir

#: Bins of a feature (as the library's trees have), rows of a chunk, and rounds between two writes of the weights.
BINS, CHUNK, KEEP = 32, 20_000, 20
#: Sums of all tasks that the driver adds up by itself, at most.
DRIVER_BYTES = 16 << 20

_CHUNKS = "bins binary, classes binary, folds binary, weights binary"


@dataclass(frozen=True)
class Stump:
    """Class ``left`` where the feature is at most the threshold, else (and where it is missing) ``right``."""

    alpha: float
    feature: int
    split: int  # bins up to this one are left; -1: none is
    threshold: float
    left: int
    right: int


@dataclass
class Run:
    """One training: a learning rate, and the fold that it leaves out (None: no fold)."""

    rate: float
    fold: int | None
    stumps: list[Stump] = field(default_factory=list)
    over: bool = False


def thresholds(rows: DataFrame, features: str, bins: int = BINS) -> list[np.ndarray]:
    """Distinct upper ends of the bins of each feature, from approximate quantiles in one aggregate."""
    size = len(rows.select(features).first()[0])
    wide = rows.select(*[vector_to_array(features)[i].alias(f"f{i}") for i in range(size)])
    shares = [i / bins for i in range(1, bins)]
    found = wide.agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, 10_000).alias(c) for c in wide.columns]).first()
    return [np.unique(np.array(found[c] or [], float)) for c in wide.columns]


def best_stump(weights: np.ndarray, cuts: list[np.ndarray], rate: float) -> tuple[Stump | None, bool]:
    """From weights by (feature, bin, class): the stump of greatest Gini gain and whether the run ends with it."""
    total = weights[0].sum(axis=0)
    whole, k = total.sum(), len(total)
    if whole <= 0:
        return None, True
    purity = (total @ total) / whole
    best = (1e-12 * whole, 0, -1, math.inf, int(total.argmax()), int(total.argmax()))
    for f, ends in enumerate(cuts):
        left = np.cumsum(weights[f], axis=0)[: len(ends)]
        right = total - left
        a, b = left.sum(axis=1), right.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((a > 0) & (b > 0), (left * left).sum(axis=1) / a + (right * right).sum(axis=1) / b - purity, -np.inf)
        at = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[at] > best[0] * (1 + 1e-9):
            best = (gain[at], f, at, float(ends[at]), int(left[at].argmax()), int(right[at].argmax()))
    _, f, split, threshold, one, other = best
    low = np.cumsum(weights[f], axis=0)[split] if split >= 0 else np.zeros(k)
    error = 1 - (low[one] + (total - low)[other]) / whole
    if error >= 1 - 1 / max(k, 2):
        return None, True
    alpha = rate * (math.log((1 - error) / max(error, 1e-300)) + math.log(max(k - 1, 1)))
    return Stump(alpha, f, split, threshold, one, other), error <= 1e-15


def _says(s: Stump, bins: np.ndarray) -> np.ndarray:
    return np.where(bins[:, s.feature] <= s.split, s.left, s.right)


def _packed(cuts: list[np.ndarray], classes: list[float], runs: list[Run]):
    """Rows as chunks with each run's first weights: 1, and 0 in the fold that it leaves out."""
    def chunk(held: list[tuple]) -> pa.RecordBatch:
        x, y, fold = (np.concatenate(v) for v in zip(*held, strict=True))
        bins = np.stack([np.where(np.isnan(x[:, f]), len(c), np.searchsorted(c, x[:, f], "left")) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
        weights = np.stack([np.ones(len(y)) if r.fold is None else (fold != r.fold).astype(float) for r in runs])
        blobs = (bins.tobytes(), np.searchsorted(classes, y).astype(np.int32).tobytes(), fold.astype(np.int32).tobytes(), weights.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=["bins", "classes", "folds", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
                held.append((x, b.column("y").to_numpy(), b.column("fold").to_numpy()))
            if sum(len(h[1]) for h in held) >= CHUNK:
                yield chunk(held)
                held = []
        if held:
            yield chunk(held)
    return run


def _opened(row: dict, n_features: int, n_runs: int) -> tuple[np.ndarray, ...]:
    y = np.frombuffer(row["classes"], np.int32)
    return np.frombuffer(row["bins"], np.uint8).reshape(len(y), n_features), y, np.frombuffer(row["folds"], np.int32), np.frombuffer(row["weights"]).reshape(n_runs, len(y)).copy()


def _weighed(batches: Iterator[pa.RecordBatch], latest: list[list[tuple[Stump, float]]], n_features: int) -> Iterator[tuple]:
    """Chunks with the weights after the latest stumps of each run, each with the factor that keeps sums near 1."""
    for b in batches:
        for row in b.to_pylist():
            bins, y, folds, w = _opened(row, n_features, len(latest))
            for r, stumps in enumerate(latest):
                for s, scale in stumps:
                    w[r] *= np.where(_says(s, bins) != y, math.exp(s.alpha) * scale, scale)
            yield row, bins, y, folds, w


def lockstep(rows: DataFrame, runs: list[Run], rounds: int, classes: list[float], features: str = "features", label: str = "label", fold: str = "fold") -> tuple[list[Run], DataFrame]:
    """Train all ``runs`` for ``rounds`` rounds at most; returns them with their stumps, and the chunks of rows.

    A round's sums, runs x features x bins x classes, are all that reaches the driver. Rows with a null label or fold, or
    null features, take no part; a missing value goes right."""
    spark = rows.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/boosting-{uuid.uuid4().hex}"
    known = rows.where(F.col(label).isNotNull() & F.col(fold).isNotNull() & F.col(features).isNotNull())
    cuts = thresholds(known, features)
    f, k, width = len(cuts), len(classes), BINS + 1
    known.select(vector_to_array(features).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold")).mapInArrow(_packed(cuts, classes, runs), _CHUNKS).write.parquet(f"{folder}/0")
    state = spark.read.schema(_CHUNKS).parquet(f"{folder}/0")
    latest: list[list[tuple[Stump, float]]] = [[] for _ in runs]
    shape = (len(runs), f, width, k)
    # the tasks' sums are added up here if they take little, else in a second stage
    few = state.rdd.getNumPartitions() * int(np.prod(shape)) * 8 < DRIVER_BYTES
    for m in range(rounds):
        if all(r.over for r in runs):
            break
        now = [list(x) for x in latest]

        def add_up(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for _, bins, y, _, w in _weighed(batches, now, f):
                for i in range(f):
                    key = bins[:, i].astype(np.int64) * k + y
                    for r in range(len(now)):
                        out[r, i] += np.bincount(key, w[r], width * k).reshape(width, k)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], names=["sums"])

        sums = np.zeros(np.prod(shape))
        parts = state.mapInArrow(add_up, "sums array<double>")
        if few:
            for x in parts.toArrow().column("sums").to_pylist():
                sums += x
        else:
            for x in parts.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("v")).collect():
                sums[x.pos] = x.v
        for r, (run, weights) in enumerate(zip(runs, sums.reshape(shape), strict=True)):
            if run.over:
                continue
            stump, run.over = best_stump(weights, cuts, run.rate)
            if stump is not None:
                run.stumps.append(stump)
                # the weights' sum stays between 1 and e ** alpha: no run overflows
                latest[r].append((stump, 1 / weights[0].sum()))
        if (m + 1) % KEEP == 0 and m + 1 < rounds:
            now = [list(x) for x in latest]

            def keep(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
                for row, _, _, _, w in _weighed(batches, now, f):
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (row["bins"], row["classes"], row["folds"], w.tobytes())], names=["bins", "classes", "folds", "weights"])

            state.mapInArrow(keep, _CHUNKS).write.parquet(f"{folder}/{m + 1}")
            state = spark.read.schema(_CHUNKS).parquet(f"{folder}/{m + 1}")
            latest = [[] for _ in runs]
    return runs, state


def fold_scores(state: DataFrame, runs: list[Run], sizes: list[int], n_features: int, n_classes: int) -> dict[tuple[float, int], float]:
    """(rate, rounds) -> accuracy on the rows of the fold that each run left out, summed over folds; one job for all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict = {}
        for b in batches:
            for row in b.to_pylist():
                bins, y, folds, _ = _opened(row, n_features, len(runs))
                for r, one in enumerate(runs):
                    own = folds == one.fold
                    if one.fold is None or not own.any():
                        continue
                    votes, some, truth = np.zeros((own.sum(), n_classes)), bins[own], y[own]
                    done = 0
                    for size in sorted(sizes):
                        for s in one.stumps[done:size]:
                            votes[np.arange(len(some)), _says(s, some)] += s.alpha
                        done = max(done, size)
                        right, n = out.get((r, size), (0, 0))
                        out[r, size] = (right + int((votes.argmax(axis=1) == truth).sum()), n + len(truth))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int32()), pa.array([k[1] for k in out], pa.int32()), *[pa.array([v[i] for v in out.values()], pa.int64()) for i in (0, 1)]], names=["run", "size", "correct", "n"])

    found = state.mapInArrow(run, "run int, size int, correct long, n long").groupBy("run", "size").agg(F.sum("correct").alias("correct"), F.sum("n").alias("n")).collect()
    scores: dict[tuple[float, int], float] = {}
    for x in found:
        key = (runs[x.run].rate, x.size)
        scores[key] = scores.get(key, 0.0) + x.correct / x.n
    return scores


def search(rows: DataFrame, candidates: list[dict], folds: int, classes: list[float], features: str = "features", label: str = "label", fold: str = "fold") -> tuple[dict, list[Stump]]:
    """The candidate (n_estimators, learning_rate) of best mean accuracy over the folds, the first on ties, and its stumps
    on all rows."""
    asked = [(float(c.get("learning_rate", 1.0)), int(c.get("n_estimators", 50))) for c in candidates]
    rates = sorted({r for r, _ in asked})
    runs = [Run(r, f) for r in rates for f in (None, *(range(folds) if len(asked) > 1 else ()))]
    runs, state = lockstep(rows, runs, max(n for _, n in asked), classes, features, label, fold)
    best = 0
    if len(asked) > 1:
        scores = fold_scores(state, runs, sorted({n for _, n in asked}), len(rows.select(features).first()[0]), len(classes))
        best = max(range(len(asked)), key=lambda i: (scores.get(asked[i], 0.0), -i))
    rate, size = asked[best]
    return candidates[best], next(r.stumps for r in runs if r.rate == rate and r.fold is None)[:size]


def votes(stumps: list[Stump], classes: list[float], x: Column) -> Column:
    """Each class's share of the votes, for an array column of features."""
    if not stumps:
        return F.array(*[F.lit(1.0 / len(classes)) for _ in classes])
    table = F.array(*[F.struct(F.lit(s.feature).alias("f"), F.lit(s.threshold if s.split >= 0 else -math.inf).alias("t"), F.lit(s.left).alias("l"), F.lit(s.right).alias("r"), F.lit(s.alpha).alias("a")) for s in stumps])
    total = sum(s.alpha for s in stumps) or 1.0

    def one(c: int) -> Column:
        def add(acc: Column, s: Column) -> Column:
            v = F.get(x, s["f"])
            said = F.when((v <= s["t"]) & ~F.isnan(v), s["l"]).otherwise(s["r"])
            return acc + F.when(said == c, s["a"]).otherwise(F.lit(0.0))
        return F.aggregate(table, F.lit(0.0), add) / F.lit(total)

    return F.array(*[one(c) for c in range(len(classes))])


def predict(stumps: list[Stump], classes: list[float], df: DataFrame, features: str = "features") -> DataFrame:
    """``df`` with prediction (ties: the first class) and probability, the shares of the votes."""
    out = df.withColumn("probability", votes(stumps, classes, vector_to_array(F.col(features))))
    at = F.array_position(F.col("probability"), F.array_max("probability"))
    return out.withColumn("prediction", F.element_at(F.array(*[F.lit(float(c)) for c in classes]), at.cast("int")))
