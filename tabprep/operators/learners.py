"""Learner registry.

Library learners are ``pyspark.ml`` estimators with the regulariser mapped so the
optimum equals the reproduced objective; learners Spark lacks are plain
DataFrame jobs: baselines (one aggregate), Gaussian naive Bayes (one grouped
aggregate + a literal log-likelihood projection), exact k nearest neighbours
(cells around pivots with triangle-inequality bounds; only k candidates per test
row and block leave a task), AdaBoost (a driver loop
of weighted depth-limited trees with re-weighting as column expressions).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
    RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabprep.functions.exprs import qcol
from tabprep.session import cut_lineage

# --------------------------------------------------------------------------- baselines


def majority_class(train: DataFrame, label: str = "label"):
    """L1: most frequent class, smallest on ties."""
    r = train.where(qcol(label).isNotNull()).groupBy(qcol(label).alias("c")).count() \
             .orderBy(F.col("count").desc(), F.col("c").asc()).limit(1).collect()
    return r[0]["c"] if r else None


def mean_value(train: DataFrame, label: str = "label") -> float | None:
    """L2."""
    return train.agg(F.avg(qcol(label).cast("double"))).first()[0]


# --------------------------------------------------------------------------- linear models


def label_std(train: DataFrame, label: str = "label") -> tuple[int, float]:
    r = train.agg(F.count(qcol(label)).alias("n"), F.stddev_samp(qcol(label)).alias("sd")).first()
    return r["n"], r["sd"] or 0.0


def linear_model(kind: str, n: int, y_std: float, alpha: float = 1.0, l1_ratio: float = 0.5,
                 features: str = "features", label: str = "label") -> LinearRegression:
    """L4–L7 with the penalty of the reproduced objective
    ``1/(2n)·RSS + alpha·l1·|w|₁ + alpha·(1−l1)/2·|w|²`` (ridge: ``RSS + alpha·|w|²``).
    Spark scales the L2 part of its penalty by the label's standard deviation when it
    standardises the label internally, hence the ``y_std`` factor. One pass over the data;
    above 4 096 features set the solver to l-bfgs."""
    base = dict(featuresCol=features, labelCol=label, standardization=False, maxIter=1000, tol=1e-10)
    if kind == "linear":
        return LinearRegression(regParam=0.0, solver="normal", **base)
    if kind == "ridge":
        return LinearRegression(regParam=alpha * y_std / n, elasticNetParam=0.0, solver="normal", **base)
    if kind == "lasso":
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, solver="normal", **base)
    if kind == "elastic_net":
        l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * y_std
        reg = l1 + l2
        return LinearRegression(regParam=reg, elasticNetParam=(l1 / reg) if reg else 0.0, solver="normal", **base)
    raise ValueError(kind)


# --------------------------------------------------------------------------- Gaussian naive Bayes


@dataclass
class GaussianNBModel:
    classes: list
    priors: list
    means: list
    variances: list
    features: list = field(default_factory=list)

    def log_likelihood(self, k: int):
        ll = F.lit(math.log(self.priors[k]))
        for j, f in enumerate(self.features):
            v = self.variances[k][j]
            ll = ll - F.lit(0.5 * math.log(2 * math.pi * v)) \
                - (qcol(f).cast("double") - F.lit(self.means[k][j])) ** 2 / F.lit(2 * v)
        return ll

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """argmax of the joint log-likelihood; ties → the first (smallest) class."""
        best = F.greatest(*[F.struct(self.log_likelihood(k).alias("ll"), F.lit(-k).alias("neg"))
                            for k in range(len(self.classes))]) if len(self.classes) > 1 else \
            F.struct(F.lit(0.0).alias("ll"), F.lit(0).alias("neg"))
        lookup = F.element_at(F.array(*[F.lit(c) for c in self.classes]), (-best["neg"] + 1).cast("int"))
        return df.withColumn(out, lookup)

    def probability(self):
        """Array of each class's posterior."""
        ll = F.array(*[self.log_likelihood(k) for k in range(len(self.classes))])
        shifted = F.transform(ll, lambda x: F.exp(x - F.array_max(ll)))
        total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
        return F.transform(shifted, lambda x: x / total)


def fit_gaussian_nb(train: DataFrame, features: list[str], label: str = "label",
                    var_smoothing: float = 1e-9) -> GaussianNBModel:
    """One grouped aggregate (count, mean, population variance per class and
    feature) plus one global variance aggregate for the smoothing epsilon."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for j, f in enumerate(features):
        aggs += [F.avg(qcol(f).cast("double")).alias(f"m{j}"), F.var_pop(qcol(f).cast("double")).alias(f"v{j}")]
    rows = train.groupBy(qcol(label).alias("_c")).agg(*aggs).orderBy("_c").collect()
    gv = train.agg(*[F.var_pop(qcol(f).cast("double")).alias(f"g{j}") for j, f in enumerate(features)]).first()
    eps = var_smoothing * max([gv[f"g{j}"] or 0.0 for j in range(len(features))] or [0.0])
    n = sum(r["_n"] for r in rows)
    return GaussianNBModel(classes=[r["_c"] for r in rows], priors=[r["_n"] / n for r in rows],
                           means=[[r[f"m{j}"] for j in range(len(features))] for r in rows],
                           variances=[[(r[f"v{j}"] or 0.0) + eps for j in range(len(features))] for r in rows],
                           features=features)


# --------------------------------------------------------------------------- k nearest neighbours

KNN_BLOCK_BYTES = 16 * 1024 * 1024
#: Cells of the train rows at most; what is known of a cell (pivot, rows, radii) is sent to all tasks.
KNN_PIVOTS = 1024
#: Cells of the rows that take no part in distances: train rows with a NaN, and the first train rows by key for test rows with one.
_ODD, _FIRST = -1, -2


def _distances(Q: np.ndarray, X: np.ndarray, metric: str):
    """(start, distances to all of X) of runs of rows of Q, a bounded number at a time."""
    step = max(1, int(4e6 // max(1, X.size)))
    for at in range(0, len(Q), step):
        diff = Q[at:at + step, None, :] - X[None, :, :]
        yield at, np.abs(diff).sum(axis=2) if metric == "manhattan" else np.sqrt((diff ** 2).sum(axis=2))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=np.float64) for a in column])


def _few(Q: np.ndarray, X: np.ndarray, k: int, metric: str):
    """(start, rows of Q from there, rows of X, distances) of a few pairs that hold the k nearest of each row of Q, all ties of
    the last included. Euclid's squares come by one matrix product and tell the pairs up to their rounding error; the
    distances of those pairs are then computed from the differences. Where a distance isn't finite, all pairs are given."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares, own = (X * X).sum(axis=1), (Q * Q).sum(axis=1)
    top = float(squares.max(initial=0.0))
    if metric == "manhattan" or not np.isfinite(4 * (top + own.max(initial=0.0))):
        for at, D in _distances(Q, X, metric):
            with np.errstate(invalid="ignore"):
                near = D <= np.partition(D, k - 1, axis=1)[:, k - 1:k]
            r, c = np.nonzero(near | np.isnan(D).any(axis=1, keepdims=True))
            yield at, r, c, D[r, c]
        return
    step, pairs = max(1, int(4e6 // max(1, len(X)))), max(1, int(4e6 // max(1, X.shape[1])))
    for at in range(0, len(Q), step):
        some = Q[at:at + step]
        D = some @ X.T
        D *= -2
        D += squares
        D += own[at:at + step, None]
        wrong = 8 * (X.shape[1] + 8) * np.finfo(float).eps * (own[at:at + step] + top)
        r, c = np.nonzero(D <= (np.partition(D, k - 1, axis=1)[:, k - 1] + 2 * wrong)[:, None])
        d = np.concatenate([np.sqrt(((some[r[i:i + pairs]] - X[c[i:i + pairs]]) ** 2).sum(axis=1)) for i in range(0, len(r), pairs)])
        yield at, r, c, d


def _nearest(k: int, metric: str, key: str, vec: str):
    """The k nearest train rows of each test row of a pair of blocks, by (distance, train key)."""
    def run(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame({key: q[key][:0], "_tid": t["_tid"][:0], "_d": np.zeros(0), "_y": t["_y"][:0]})
        place = np.unique(t["_tid"].to_numpy(), return_inverse=True)[1]
        kk, out = min(k, len(t)), []
        for at, r, c, d in _few(_matrix(q[vec]), _matrix(t[vec]), kk, metric):
            order = np.lexsort((place[c], d, r))
            r, c, d = r[order], c[order], d[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < kk
            near = t.iloc[c[first]]
            out.append(pd.DataFrame({key: q[key].to_numpy()[at + r[first]], "_tid": near["_tid"].to_numpy(), "_d": d[first], "_y": near["_y"].to_numpy()}))
        return pd.concat(out)
    return run


def _to_cells(pivots: np.ndarray, metric: str, vec: str):
    """Train rows with the cell of their nearest pivot and the distance from it."""
    def run(frames):
        for f in frames:
            cell, far = np.full(len(f), _ODD), np.zeros(len(f))
            X = _matrix(f[vec]) if len(f) else np.zeros((0, pivots.shape[1]))
            for at, D in _distances(X, pivots, metric):
                known = ~np.isnan(D).any(axis=1)
                cell[at:at + len(D)] = np.where(known, np.argmin(D, axis=1), _ODD)
                far[at:at + len(D)] = np.where(known, D.min(axis=1), 0.0)
            yield f.assign(_cell=cell, _far=far)
    return run


def _routes(pivots: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, metric: str, vec: str, again: bool):
    """Test rows once for each cell to visit: at first the cells of the nearest pivots that hold k rows together; ``again``:
    the other cells that can hold a row at most _reach away, by the triangle inequality.

    Of a cell with pivot p, a row x at d(x, p) between least and most, which is not nearer to q's own pivot o, is at least
    d(q, p) - most, least - d(q, p), and (d(q, p) - d(q, o)) / 2 away from q; for Euclid the last is the distance of the
    plane between p and o. What rounding may have changed is granted."""
    between = np.concatenate([D for _, D in _distances(pivots, pivots, metric)])

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            place, cell = [], []
            for at, D in _distances(_matrix(f[vec]), pivots, metric):
                odd = np.isnan(D).any(axis=1)
                order = np.argsort(D, axis=1, kind="stable")
                before = np.cumsum(rows[order], axis=1) - rows[order]
                visit = np.zeros(D.shape, bool)
                np.put_along_axis(visit, order, before < k, axis=1)
                if again:
                    own = order[:, :1]
                    d_own = np.take_along_axis(D, own, axis=1)
                    if metric == "manhattan":
                        beyond = (D - d_own) / 2
                    else:
                        apart = between[own[:, 0]]
                        beyond = np.divide(D * D - d_own * d_own, 2 * apart, out=np.zeros(D.shape), where=apart > 0)
                    bound = np.maximum(np.maximum(D - most, least - D), beyond)
                    reach = f["_reach"].to_numpy(float)[at:at + len(D), None]  # NaN: all cells were visited
                    visit = ~visit & (bound <= reach + 1e-9 * (reach + D + most))
                visit &= (rows > 0) & ~odd[:, None]
                r, c = np.nonzero(visit)
                place.append(r + at)
                cell.append(c)
                if not again:
                    for some, where in ((np.flatnonzero(odd), _FIRST), (np.flatnonzero(~odd & (rows.sum() < k)), _ODD)):
                        place.append(some + at)
                        cell.append(np.full(len(some), where))
            out = f.iloc[np.concatenate(place)].drop(columns="_reach", errors="ignore")
            yield out.assign(_cell=np.concatenate(cell).astype(np.int32))
    return run


def knn_neighbours(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int = 5, metric: str = "euclidean",
                   block_rows: int | None = None) -> DataFrame:
    """(key, _tid, _d, _y, _r): the k nearest train rows of each test row, ties by the smaller train key; exact.

    Train rows belong to the cell of the nearest of up to KNN_PIVOTS train rows. A test row first visits the nearest cells,
    which bounds the distance of its k-th neighbour, and then only those cells that can hold a row within it. Cells are cut
    into blocks of bounded size on both sides, by a hash of the key, so that copies of one vector don't meet in one task; a
    pair of blocks is one task and yields k rows for each test row. A train set of one block is one cell.

    A distance from or to a vector with a NaN is NaN and comes last, ties by the train key."""
    spark = train.sparkSession
    tr = train.select(qcol(key).alias("_tid"), qcol(vec).alias(vec), qcol(label).alias("_y"))
    te = test.select(key, vec)
    n_train, dim = tr.agg(F.count(F.lit(1)), F.max(F.size(vec))).first()
    per_block = block_rows or max(1, KNN_BLOCK_BYTES // max(1, (dim or 1) * 8 + 16))
    blocks = max(1, math.ceil(n_train / per_block))
    schema = T.StructType([test.schema[key], T.StructField("_tid", train.schema[key].dataType),
                           T.StructField("_d", T.DoubleType()), T.StructField("_y", train.schema[label].dataType)])
    nearest = Window.partitionBy(key).orderBy("_d", "_tid")

    def visited(routed: DataFrame, placed: DataFrame, rows: dict[int, int]) -> DataFrame:
        """The k nearest in each cell that a test row is routed to."""
        asked = {r["_cell"]: r["count"] for r in routed.groupBy("_cell").count().collect()}  # one row a cell
        sizes = F.broadcast(spark.createDataFrame([(c, math.ceil(rows.get(c, 0) / per_block), math.ceil(n / per_block)) for c, n in asked.items() if rows.get(c)],
                                                  "_cell int, _nt int, _nq int"))
        left = routed.join(sizes, "_cell").select(key, vec, "_cell", F.expr(f"pmod(xxhash64(`{key}`), _nq)").cast("int").alias("_qb"),
                                                  F.explode(F.expr("sequence(0, _nt - 1)")).alias("_tb"))
        right = placed.join(sizes, "_cell").select("_tid", vec, "_y", "_cell", F.expr("pmod(xxhash64(_tid), _nt)").cast("int").alias("_tb"),
                                                   F.explode(F.expr("sequence(0, _nq - 1)")).alias("_qb"))
        pair = ["_cell", "_qb", "_tb"]
        found = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInPandas(_nearest(k, metric, key, vec), schema)
        found = found.withColumn("_d", F.coalesce("_d", F.lit(float("nan"))))  # pandas hands NaN over as null, which would come first
        return found.withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k)

    pivots = np.zeros((0, dim or 1))
    if blocks > 1:
        known = tr.where(~F.exists(vec, lambda x: x.isNull() | F.isnan(x)))
        some = known.orderBy(F.xxhash64("_tid"), "_tid").limit(min(KNN_PIVOTS, 4 * blocks)).select(vec).collect()
        pivots = np.unique(np.array([r[0] for r in some], float).reshape(len(some), dim), axis=0)
    if len(pivots) < 2:
        one = F.lit(0).alias("_cell")
        return visited(te.select("*", one), tr.select("*", one), {0: n_train})
    fields = [*tr.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())]
    placed = tr.mapInPandas(_to_cells(pivots, metric, vec), T.StructType(fields))
    rows, least, most = np.zeros((3, len(pivots)))
    held = {_FIRST: min(k, n_train)}
    for r in placed.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.min("_far").alias("a"), F.max("_far").alias("b")).collect():
        held[r["_cell"]] = r["n"]
        if r["_cell"] >= 0:
            rows[r["_cell"]], least[r["_cell"]], most[r["_cell"]] = r["n"], r["a"], r["b"]
    first_rows = tr.orderBy("_tid").limit(k).select("*", F.lit(_FIRST).alias("_cell"), F.lit(0.0).alias("_far"))
    routed_schema = T.StructType([*te.schema.fields, T.StructField("_cell", T.IntegerType())])

    def routes(rows_in: DataFrame, again: bool) -> DataFrame:
        return rows_in.mapInPandas(_routes(pivots, rows, least, most, k, metric, vec, again), routed_schema)

    first = cut_lineage(visited(routes(te, False), placed.unionByName(first_rows), held))
    reach = first.where(F.col("_r") == k).select(key, F.col("_d").alias("_reach"))
    more = visited(routes(te.join(reach, key), True), placed, held)
    return first.drop("_r").unionByName(more.drop("_r")).withColumn("_r", F.row_number().over(nearest)).where(F.col("_r") <= k)


def knn_vote(near: DataFrame, key: str, k: int, weights: str = "uniform", task: str = "classification", shares: bool = False) -> DataFrame:
    """(key, prediction) from the first k neighbours of a table of ``knn_neighbours``, which may hold more."""
    wt = F.lit(1.0) if weights == "uniform" else F.when(F.col("_d") == 0, F.lit(1e300)).otherwise(1.0 / F.col("_d"))
    top = near.where(F.col("_r") <= k).withColumn("_w", wt)
    if task == "classification":
        votes = top.groupBy(key, "_y").agg(F.sum("_w").alias("_v"))
        wv = Window.partitionBy(key).orderBy(F.col("_v").desc(), F.col("_y").asc())
        best = votes.withColumn("_r", F.row_number().over(wv)).where(F.col("_r") == 1) \
                    .select(key, F.col("_y").alias("prediction"))
        if shares:  # at most k classes a row
            best = best.join(votes.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_y", "_v"))).alias("_m"),
                                                    F.sum("_v").alias("_all")), key) \
                       .select(key, "prediction", F.transform_values("_m", lambda _, v: v / F.col("_all")).alias("shares"))
        return best
    return top.groupBy(key).agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("prediction"))


def knn_predict(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int = 5,
                weights: str = "uniform", metric: str = "euclidean", task: str = "classification",
                block_rows: int | None = None, shares: bool = False) -> DataFrame:
    """Exact kNN by cells (``knn_neighbours``). Neighbour ties break on the train key; vote ties on the smallest class.
    Returns (key, prediction), with ``shares`` also a map of class to its share of the votes; keys and classes keep their
    types. Without train rows every prediction is null."""
    if train.isEmpty():
        return test.select(key, F.lit(None).cast(train.schema[label].dataType).alias("prediction"))
    return knn_vote(knn_neighbours(train, test, key, vec, label, k, metric, block_rows), key, k, weights, task, shares)


# --------------------------------------------------------------------------- AdaBoost


def adaboost(train: DataFrame, task: str, n_estimators: int = 50, learning_rate: float = 1.0,
             features: str = "features", label: str = "label", checkpoint_every: int = 10):
    """SAMME (classification, depth-1 trees) / AdaBoost.R2 with linear loss
    (regression, depth-3 trees). Sample weights live in a column; each round is one
    weighted tree fit plus one aggregate; lineage is cut every few rounds with a
    reliable checkpoint. Returns a list of (weight, tree model) and the class list."""
    df = train.select(features, label).withColumn("_w", F.lit(1.0))
    n = df.count()
    df = df.withColumn("_w", F.lit(1.0 / n))
    classes = sorted(r[0] for r in df.select(label).distinct().collect()) if task == "classification" else []
    K = len(classes)
    ensemble = []
    for m in range(n_estimators):
        if task == "classification":
            tree = DecisionTreeClassifier(featuresCol=features, labelCol=label, weightCol="_w", maxDepth=1,
                                          predictionCol="_p", rawPredictionCol="_raw", probabilityCol="_prob").fit(df)
            p = tree.transform(df)
            err = p.agg((F.sum(F.when(F.col("_p") != F.col(label), F.col("_w")).otherwise(0.0)) / F.sum("_w"))).first()[0]
            if err is None or err >= 1 - 1.0 / max(K, 2):
                break
            alpha = learning_rate * (math.log((1 - err) / max(err, 1e-300)) + math.log(max(K - 1, 1)))
            ensemble.append((alpha, tree))
            if err <= 0:
                break
            df = p.withColumn("_w", F.when(F.col("_p") != F.col(label), F.col("_w") * math.exp(alpha))
                              .otherwise(F.col("_w"))).select(features, label, "_w")
        else:
            tree = DecisionTreeRegressor(featuresCol=features, labelCol=label, weightCol="_w", maxDepth=3,
                                         predictionCol="_p").fit(df)
            p = tree.transform(df).withColumn("_e", F.abs(F.col("_p") - F.col(label)))
            emax = p.agg(F.max("_e")).first()[0]
            if not emax:
                ensemble.append((1.0, tree))
                break
            p = p.withColumn("_l", F.col("_e") / F.lit(emax))
            err = p.agg(F.sum(F.col("_l") * F.col("_w")) / F.sum("_w")).first()[0]
            if err >= 0.5:
                if not ensemble:
                    ensemble.append((1.0, tree))
                break
            beta = err / (1 - err)
            ensemble.append((learning_rate * math.log(1 / max(beta, 1e-300)), tree))
            df = p.withColumn("_w", F.col("_w") * F.pow(F.lit(beta), (1 - F.col("_l")) * learning_rate)) \
                  .select(features, label, "_w")
        tot = df.agg(F.sum("_w")).first()[0]
        df = df.withColumn("_w", F.col("_w") / F.lit(tot))
        if (m + 1) % checkpoint_every == 0:
            df = cut_lineage(df)
    return ensemble, classes


def adaboost_predict(ensemble, classes, df: DataFrame, task: str, out: str = "prediction",
                     probability: str | None = None) -> DataFrame:
    """Weighted vote (classification) or weighted median of the trees (regression); ``probability``
    names a column for each class's share of the votes."""
    res, preds = df, []
    for i, (a, tree) in enumerate(ensemble):
        t = tree.copy()
        t.setPredictionCol(f"__tree_p{i}")
        if task == "classification":
            t.setRawPredictionCol(f"__tree_r{i}").setProbabilityCol(f"__tree_q{i}")
        res = t.transform(res)
        preds.append((a, f"__tree_p{i}"))
    if task == "classification":
        scores = [F.struct(sum((F.when(F.col(p) == F.lit(c), F.lit(a)).otherwise(0.0) for a, p in preds), F.lit(0.0))
                           .alias("s"), F.lit(-j).alias("neg")) for j, c in enumerate(classes)]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        if probability:
            total = F.lit(sum(a for a, _ in preds) or 1.0)
            res = res.withColumn(probability, F.array(*[x["s"] / total for x in scores]))
        pred = F.element_at(F.array(*[F.lit(float(c)) for c in classes]), (-best["neg"] + 1).cast("int"))
    else:
        arr = F.array_sort(F.array(*[F.struct(F.col(p).alias("v"), F.lit(a).alias("a")) for a, p in preds]))
        half = 0.5 * sum(a for a, _ in preds)
        cum = F.aggregate(arr, F.struct(F.lit(0.0).alias("acc"), F.lit(None).cast("double").alias("med")),
                          lambda acc, x: F.struct((acc["acc"] + x["a"]).alias("acc"),
                                                  F.when(acc["med"].isNull() & (acc["acc"] + x["a"] >= F.lit(half)),
                                                         x["v"]).otherwise(acc["med"]).alias("med")))
        pred = cum["med"]
    return res.withColumn(out, pred).select(*[qcol(c) for c in df.columns if c != out], out, *([probability] if probability and task == "classification" else []))


# --------------------------------------------------------------------------- registry


@dataclass
class Learner:
    name: str
    make: object  # callable(n, y_std, n_classes) -> Estimator
    grid: dict
    fast: bool
    kind: str = "ml"  # ml | baseline | adaboost | gbt | knn | nb


def classification_learners(fast_only: bool = False, include_svm: bool = False) -> list[Learner]:
    """L1, L3, L8–L14 for classification (grids as in the reproduced registry)."""
    def lr(n, sd, k, C=1.0):
        return LogisticRegression(regParam=1.0 / (C * n), elasticNetParam=0.0, standardization=False, maxIter=1000)

    def tree(n, sd, k, maxDepth=5, minInstancesPerNode=1):
        return DecisionTreeClassifier(maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, seed=42)

    def forest(n, sd, k, numTrees=100, maxDepth=10, minInstancesPerNode=1):
        return RandomForestClassifier(numTrees=numTrees, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode,
                                      featureSubsetStrategy="sqrt", seed=42)

    def gbt(n, sd, k, maxIter=100, stepSize=0.1, maxDepth=3):
        est = GBTClassifier(maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth, seed=42)
        return est if k <= 2 else OneVsRest(classifier=est)

    def svm(n, sd, k, C=1.0):
        est = LinearSVC(regParam=1.0 / (C * n), standardization=False, maxIter=1000, tol=1e-4)
        return est if k <= 2 else OneVsRest(classifier=est)

    regs = [
        Learner("dummy", None, {}, True, "baseline"),
        Learner("logistic_regression", lr, {"C": [0.01, 0.1, 1, 10]}, True),
        Learner("knn", None, {"k": [3, 5, 7, 9], "weights": ["uniform", "distance"],
                              "metric": ["euclidean", "manhattan"]}, False, "knn"),
        Learner("naive_bayes", None, {"var_smoothing": [1e-9, 1e-8, 1e-7]}, True, "nb"),
        Learner("decision_tree", tree, {"maxDepth": [3, 5, 10, 30], "minInstancesPerNode": [1, 2, 4]}, True),
        Learner("random_forest", forest, {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 20, 30],
                                          "minInstancesPerNode": [1, 2, 4]}, False),
        Learner("gradient_boosting", gbt, {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.3],
                                           "maxDepth": [3, 5, 7]}, False, "gbt"),
        Learner("adaboost", None, {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 1.0]}, False, "adaboost"),
    ]
    if include_svm:
        regs.append(Learner("svm", svm, {"C": [0.1, 1, 10]}, False))
    return [r for r in regs if r.fast or not fast_only]


def regression_learners(fast_only: bool = False) -> list[Learner]:
    """L2, L4–L12 for regression."""
    def lin(kind):
        def make(n, sd, k, alpha=1.0, l1_ratio=0.5):
            return linear_model(kind, n, sd, alpha, l1_ratio)
        return make

    def tree(n, sd, k, maxDepth=5, minInstancesPerNode=1):
        return DecisionTreeRegressor(maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode, seed=42)

    def forest(n, sd, k, numTrees=100, maxDepth=10, minInstancesPerNode=1):
        return RandomForestRegressor(numTrees=numTrees, maxDepth=maxDepth, minInstancesPerNode=minInstancesPerNode,
                                     featureSubsetStrategy="all", seed=42)

    def gbt(n, sd, k, maxIter=100, stepSize=0.1, maxDepth=3):
        return GBTRegressor(maxIter=maxIter, stepSize=stepSize, maxDepth=maxDepth, seed=42)

    regs = [
        Learner("dummy", None, {}, True, "baseline"),
        Learner("linear_regression", lin("linear"), {}, True),
        Learner("ridge", lin("ridge"), {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0]}, True),
        Learner("lasso", lin("lasso"), {"alpha": [0.01, 0.1, 1.0, 10.0]}, True),
        Learner("elastic_net", lin("elastic_net"), {"alpha": [0.01, 0.1, 1.0], "l1_ratio": [0.2, 0.5, 0.8]}, True),
        Learner("knn", None, {"k": [3, 5, 7, 9], "weights": ["uniform", "distance"],
                              "metric": ["euclidean", "manhattan"]}, False, "knn"),
        Learner("decision_tree", tree, {"maxDepth": [3, 5, 10, 30], "minInstancesPerNode": [1, 2, 4]}, True),
        Learner("random_forest", forest, {"numTrees": [50, 100, 200], "maxDepth": [5, 10, 20, 30],
                                          "minInstancesPerNode": [1, 2, 4]}, False),
        Learner("gradient_boosting", gbt, {"maxIter": [50, 100, 200], "stepSize": [0.01, 0.1, 0.3],
                                           "maxDepth": [3, 5, 7]}, False),
        Learner("adaboost", None, {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 1.0]}, False, "adaboost"),
    ]
    return [r for r in regs if r.fast or not fast_only]


def probability_of(df: DataFrame, col: str = "probability", index: int = 1) -> DataFrame:
    """Positive-class probability as a plain double column ``score``."""
    return df.withColumn("score", vector_to_array(F.col(col))[index])
