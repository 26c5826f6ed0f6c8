"""M19 fast path for moment-based models (nearest centroid, LDA): fit once, score once.

For k-fold CV every training set is "all rows minus one fold".  One pass of
mergeable co-moments per (fold, class) therefore gives, by merging all folds but one, the training
statistics of every fold: scaling parameters, ANOVA F ranking, class means and the pooled
covariance.  The per-fold models are tiny (folds x sizes x classes coefficient rows, a bounded
table that is broadcast); every held-out row is scored against its own fold's models in one
map-side pass, with no shuffle of the rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .comoments import grouped_moments, merge
from .logistic_grid import Problem, fit_logistic


def fold_moments(folded: DataFrame, features: list[str], label: str = "prof_level",
                 fold: str = "fold") -> dict:
    """{(fold, class): (n, mean, scatter)} from one pass (mergeable co-moments)."""
    return grouped_moments(folded, features, label, fold)


def _train_stats(mom: dict, k) -> dict:
    """{class: (n, mean, scatter)} of all folds but k."""
    stats: dict = {}
    for (f, c) in sorted(mom):
        if f != k:
            stats[c] = merge(stats.get(c), mom[f, c])
    return stats


def _spread(stats: dict) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """n, mean, and the sums of squares between and within the classes, for each feature."""
    n = sum(v[0] for v in stats.values())
    mean = sum(v[0] * v[1] for v in stats.values()) / n
    between = sum(v[0] * (v[1] - mean) ** 2 for v in stats.values())
    return n, mean, between, np.diag(sum(v[2] for v in stats.values()))


def _scaling(stats: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each feature; a constant one is divided by 1."""
    n, mean, between, within = _spread(stats)
    sd = np.sqrt((between + within) / n)
    return mean, np.where(sd > 0, sd, 1.0)


def _anova_rank(stats: dict, features: list[str]) -> list[int]:
    n, _, between, within = _spread(stats)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (between / (len(stats) - 1)) / (within / (n - len(stats)))
    f = np.where(np.isfinite(f), f, -np.inf)
    return sorted(range(len(features)), key=lambda i: (-f[i], features[i]))


def cv_models(mom: dict, features: list[str], models: list[str], sizes: list[int]) -> list[tuple]:
    """Rows (model, n_features, fold, cls, mu, w, b): class scores are
    nearest centroid: Σ w (x - mu)² (w = 1 / sd² of the training folds, min wins);
    LDA: -(x·w + b) (min wins).  Unselected features get weight 0."""
    d = len(features)
    rows = []
    for k in sorted({f for (f, _) in mom}):
        st = _train_stats(mom, k)
        n = sum(v[0] for v in st.values())
        _, sd = _scaling(st)
        order = _anova_rank(st, features)
        means = {c: v[1] for c, v in st.items()}
        for size in sizes:
            sel = sorted(order[:size])
            mask = np.zeros(d)
            mask[sel] = 1.0
            for model in models:
                if model == "nearest_centroid":
                    w = mask / sd ** 2
                    for c in sorted(st):
                        rows.append((model, size, k, c, means[c].tolist(), w.tolist(), 0.0))
                elif model == "lda":
                    # in units of the deviations, so no feature's scale decides what counts as zero
                    scatter = sum(v[2] for v in st.values()) / np.outer(sd, sd)
                    inv = np.linalg.pinv(scatter[np.ix_(sel, sel)] / max(n - len(st), 1), hermitian=True)
                    for c in sorted(st):
                        mu = means[c][sel] / sd[sel]
                        wsel = inv @ mu
                        w = np.zeros(d)
                        w[sel] = wsel / sd[sel]
                        b = -0.5 * mu @ wsel + math.log(st[c][0] / n)
                        rows.append((model, size, k, c, [0.0] * d, w.tolist(), float(b)))
                else:
                    raise ValueError(f"{model} has no moment form")
    return rows


def logistic_problems(mom: dict, features: list[str], sizes: list[int], c: float = 1.0) -> list[tuple[int, Problem]]:
    """(size, problem) for every fold and number of features, chosen and scaled without the fold."""
    out = []
    for k in sorted({f for (f, _) in mom}):
        st = _train_stats(mom, k)
        mean, sd = _scaling(st)
        order = _anova_rank(st, features)
        for size in sizes:
            mask = np.zeros(len(features))
            mask[order[:size]] = 1.0
            out.append((size, Problem(k, mask, mean, sd, sum(v[0] for v in st.values()), c)))
    return out


def logistic_rows(folded: DataFrame, mom: dict, features: list[str], sizes: list[int], label: str = "prof_level",
                  fold: str = "fold") -> list[tuple]:
    """Model rows, as of `cv_models`, of the logistic regressions of all folds and sizes, fitted together."""
    classes = sorted({c for (_, c) in mom})
    sized = logistic_problems(mom, features, sizes)
    fitted = fit_logistic(folded, features, classes, [p for _, p in sized], label, fold)
    rows = []
    for (size, _), p in zip(sized, fitted):
        if not p.converged:
            raise ValueError(f"logistic regression without convergence: fold {p.fold}, {size} features, {p.passes} passes")
        w, b = p.raw()
        rows += [("logistic_regression", size, p.fold, c, [0.0] * len(features), w[i].tolist(), float(b[i])) for i, c in enumerate(classes)]
    return rows


MODEL_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("n_features", T.IntegerType()),
    T.StructField("fold", T.IntegerType()), T.StructField("cls", T.StringType()),
    T.StructField("mu", T.ArrayType(T.DoubleType())), T.StructField("w", T.ArrayType(T.DoubleType())),
    T.StructField("b", T.DoubleType())])


def cv_predictions(folded: DataFrame, features: list[str], models: list[str], sizes: list[int],
                   key: str = "doc_id", label: str = "prof_level", fold: str = "fold") -> DataFrame:
    """Out-of-fold predictions (key, fold, label, prediction, model, n_features) of every
    (model, size) with one aggregate, one bounded broadcast table and one scoring pass."""
    mom = fold_moments(folded, features, label, fold)
    rows = cv_models(mom, features, [m for m in models if m != "logistic_regression"], sizes)
    if "logistic_regression" in models:
        rows += logistic_rows(folded, mom, features, sizes, label, fold)
    return score_models(folded, features, rows, key, label, fold)


def centroid_rows(mom: dict, features: list[str], subsets: list[list[str]]) -> list[tuple]:
    """Nearest-centroid model rows (unweighted distance over each feature subset) for every
    fold, from the fold moments; `n_features` carries the subset index."""
    rows = []
    for k in sorted({f for (f, _) in mom}):
        st = _train_stats(mom, k)
        for i, sub in enumerate(subsets):
            w = [1.0 if f in sub else 0.0 for f in features]
            for c in sorted(st):
                rows.append(("nearest_centroid", i, k, c, st[c][1].tolist(), w, 0.0))
    return rows


def score_models(folded: DataFrame, features: list[str], rows: list[tuple], key: str = "doc_id",
                 label: str = "prof_level", fold: str = "fold") -> DataFrame:
    """Score every held-out row with each model row of its own fold (broadcast join of a
    table bounded by folds x models x classes; no shuffle of the rows)."""
    spark: SparkSession = folded.sparkSession
    # folds x models x classes rows, however many rows are scored
    table = spark.createDataFrame(pa.Table.from_pylist([dict(zip(MODEL_SCHEMA.names, r)) for r in rows], to_arrow_schema(MODEL_SCHEMA)))
    grouped = table.groupBy("model", "n_features", F.col("fold").alias("_mfold")).agg(
        F.collect_list(F.struct("cls", "mu", "w", "b")).alias("_cls"))
    x = F.array(*[F.col(f).cast("double") for f in features])
    held = folded.select(key, fold, F.col(label).alias("label"), x.alias("_x"))
    j = held.join(F.broadcast(grouped), held[fold] == grouped["_mfold"])
    score = F.expr("""transform(_cls, c -> named_struct(
        's', IF(model = 'nearest_centroid',
                aggregate(zip_with(zip_with(_x, c.mu, (a, m) -> a - m), c.w, (dd, ww) -> dd * dd * ww), 0D, (acc, v) -> acc + v),
                -(aggregate(zip_with(_x, c.w, (a, ww) -> a * ww), 0D, (acc, v) -> acc + v) + c.b)),
        'cls', c.cls))""")
    return j.select(key, fold, "label", F.array_min(score)["cls"].alias("prediction"),
                    "model", F.col("n_features"))
