"""M10-M18, M28 and helper H1: classifiers over the feature table.

Model parameters are small (classes x features); fitting is distributed (Spark ML, or one
aggregate for the moment-based models) and scoring is a column expression or a Spark ML
transform, so prediction never moves data to the driver.

Estimators (reference defaults -> Spark):
  M10 logistic regression, L2, C = 1       -> logistic_grid, one problem run to convergence
  M11 logistic regression with 5-fold CV   -> logistic_grid, C = 10^linspace(-4, 4, 10) on 5 class-balanced folds,
                                              all fits together, the best C fitted again on all rows
  M12 RBF support vector classifier        -> pairwise_svm, one machine for each pair of classes over
                                              random Fourier features (gamma = 1/d; an approximation)
  M13 random forest, seed 0                -> RandomForestClassifier(numTrees=100, seed=0)
  M14 one-hidden-layer perceptron, seed 0  -> MultilayerPerceptronClassifier([d, 100, k])
  M15 / M16 LDA / QDA                      -> class moments in one aggregate, scoring as columns
  H1 nearest centroid (test helper)        -> class means, arg-min distance as columns
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LEVELS
from .comoments import grouped_moments
from .logistic_grid import Problem, fit_logistic
from .pairwise_svm import fit_pairwise, known_rows
from .sampling import range_rank, salted_rank, stratified_folds

# ---- H1: nearest centroid ------------------------------------------------------------------

def fit_centroids(train: DataFrame, features: list[str], label: str = "prof_level") -> dict:
    """Class means (k x d, a bounded model parameter)."""
    rows = train.groupBy(label).agg(*[F.avg(f).alias(f) for f in features]).collect()
    return {r[label]: [r[f] for f in features] for r in rows}


def nearest_centroid(centroids: dict, features: list[str]) -> Column:
    """Arg-min squared distance to the class means; ties go to the smaller label."""
    cands = []
    for cls, mu in sorted(centroids.items()):
        d = sum(((F.col(f) - F.lit(float(m))) * (F.col(f) - F.lit(float(m))) for f, m in zip(features, mu)),
                F.lit(0.0))
        cands.append(F.struct(d.alias("d"), F.lit(cls).alias("c")))
    return F.array_min(F.array(*cands))["c"]


def predict_centroid(df: DataFrame, centroids: dict, features: list[str], key: str = "doc_id",
                     label: str = "prof_level", keep: tuple[str, ...] = ()) -> DataFrame:
    """M17 with H1: (key, label, prediction, *keep)."""
    return df.select(key, F.col(label).alias("label"),
                     nearest_centroid(centroids, features).alias("prediction"), *keep)


# ---- Spark ML estimators -------------------------------------------------------------------

def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")


def _indexer(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc",
                         handleInvalid="keep")


def estimator(name: str, n_features: int, n_classes: int = len(LEVELS)):
    """The Spark ML estimator of the two models that Spark has.  The perceptron's iterations end at 200.  Rows keep the
    number of their node in each tree of the forest: without that every level sends all trees, which have some
    nodes for each row, to every task and walks them from the root.  The forest is the same."""
    if name == "random_forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label_idx", numTrees=100,
                                      featureSubsetStrategy="sqrt", maxDepth=30, seed=0, cacheNodeIds=True)
    if name == "mlp":
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="label_idx",
                                              layers=[n_features, 100, n_classes], seed=0, maxIter=200,
                                              tol=1e-4)
    raise ValueError(name)


CV_PENALTIES = [10.0 ** x for x in np.linspace(-4, 4, 10)]
CV_FOLDS = 5


def _whole(d: int, n: float, c: float, fold: int | None = None) -> Problem:
    """All features, which are standardised already."""
    return Problem(fold, np.ones(d), np.zeros(d), np.ones(d), n, c)


def _linear_label(problem: Problem, classes: list[str], features: list[str]) -> Column:
    """The class of the largest score, the smaller label among equals."""
    w, b = problem.raw()
    score = [F.struct((-sum((F.col(f) * float(v) for f, v in zip(features, w[i])), F.lit(float(b[i])))).alias("s"), F.lit(c).alias("c"))
             for i, c in enumerate(classes)]
    return F.when(known_rows(features), F.array_min(F.array(*score))["c"])


def fit_logistic_model(train: DataFrame, features: list[str], label: str = "prof_level", c: float = 1.0) -> Column:
    """Multinomial logistic regression as a column."""
    known = train.where(known_rows(features) & F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    classes = sorted(sizes)
    fitted, = fit_logistic(known, features, classes, [_whole(len(features), sum(sizes.values()), c)], label)
    return _linear_label(fitted, classes, features)


def choose_penalty(train: DataFrame, features: list[str], label: str = "prof_level", key: str = "doc_id",
                   penalties: list[float] = CV_PENALTIES, folds: int = CV_FOLDS, seed: int = 0) -> tuple[float, list[float]]:
    """The C of the best mean accuracy over class-balanced folds (the smallest of equals) and
    the accuracies; the fits of all folds and penalties share every pass over the rows."""
    from .cvmoments import score_models
    known = train.where(known_rows(features) & F.col(label).isNotNull())
    folded = stratified_folds(known, folds, key, label, seed).checkpoint(eager=True)
    sizes = {(r[0], r[1]): r[2] for r in folded.groupBy("fold", label).count().collect()}
    classes, n = sorted({k for _, k in sizes}), sum(sizes.values())
    held = {k: sum(v for (f, _), v in sizes.items() if f == k) for k in sorted({f for f, _ in sizes})}
    asked = [(i, _whole(len(features), n - held[k], c, k)) for k in held for i, c in enumerate(penalties) if held[k] < n]
    fitted = fit_logistic(folded, features, classes, [p for _, p in asked], label, "fold")
    rows = []
    for (i, _), p in zip(asked, fitted):
        w, b = p.raw()
        rows += [("logistic_regression", i, p.fold, k, [0.0] * len(features), w[j].tolist(), float(b[j])) for j, k in enumerate(classes)]
    if not rows:
        return penalties[0], []
    hits = score_models(folded, features, rows, key, label).groupBy("n_features", "fold") \
        .agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("acc")) \
        .groupBy("n_features").agg(F.avg("acc").alias("acc"))
    scores = {r["n_features"]: round(r["acc"], 12) for r in hits.collect()}
    best = max(scores, key=lambda i: (scores[i], -i))
    return penalties[best], [scores[i] for i in sorted(scores)]


def fit(name: str, train: DataFrame, features: list[str], label: str = "prof_level"):
    """Fit one classifier on (already standardised) train rows.

    Returns `predict(df, key, keep) -> (key, label, prediction, *keep)` with string labels."""
    if name == "nearest_centroid":
        cents = fit_centroids(train, features, label)
        return lambda df, key="doc_id", keep=(): predict_centroid(df, cents, features, key, label, keep)
    if name in ("lda", "qda"):
        model = fit_discriminant(train, features, label, quadratic=(name == "qda"))
        return lambda df, key="doc_id", keep=(): df.select(key, F.col(label).alias("label"),
                                                           model.alias("prediction"), *keep)
    if name in ("logistic_regression", "logistic_regression_cv", "svc_rbf"):
        if name == "svc_rbf":
            guess = fit_pairwise(train, features, label).column(features)
        else:
            c = choose_penalty(train, features, label)[0] if name == "logistic_regression_cv" else 1.0
            guess = fit_logistic_model(train, features, label, c)
        return lambda df, key="doc_id", keep=(): df.where(known_rows(features)).select(
            key, F.col(label).alias("label"), guess.alias("prediction"), *keep)
    train = train.persist()
    idx = _indexer(label).fit(train)
    stages = [idx, _assembler(features), estimator(name, len(features), len(idx.labels) + 1),
              IndexToString(inputCol="prediction", outputCol="pred_label", labels=idx.labels)]
    model: PipelineModel = Pipeline(stages=stages).fit(train)
    train.unpersist()

    def predict(df: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
        out = model.transform(df)
        return out.select(key, F.col(label).alias("label"), F.col("pred_label").alias("prediction"), *keep)
    return predict


def fit_predict(name: str, train: DataFrame, test: DataFrame, features: list[str],
                key: str = "doc_id", label: str = "prof_level", keep: tuple[str, ...] = ()) -> DataFrame:
    """Fit on train rows and predict test rows."""
    return fit(name, train, features, label)(test, key, keep)


# ---- M15 / M16: discriminant analysis from class moments ---------------------------------------

def class_moments(df: DataFrame, features: list[str], label: str = "prof_level") -> dict:
    """{class: (n, mean, scatter)} in one pass (mergeable co-moments)."""
    return {c: m for (_, c), m in grouped_moments(df, features, label).items()}


def fit_discriminant(train: DataFrame, features: list[str], label: str = "prof_level",
                     quadratic: bool = False) -> Column:
    """LDA (pooled covariance / (n - k), priors) or QDA (class covariance / (n_k - 1)); the
    d x d solves run on the driver on k small matrices, scoring is a column expression.
    Collinear features are handled with a pseudo-inverse."""
    mom = class_moments(train, features, label)
    n = sum(v[0] for v in mom.values())
    k = len(mom)
    means = {c: mean for c, (_, mean, _) in mom.items()}
    scatter = {c: q for c, (_, _, q) in mom.items()}
    x = [F.col(f) for f in features]
    cands = []
    if not quadratic:
        cov = sum(scatter.values()) / max(n - k, 1)
        inv = np.linalg.pinv(cov)
        for c in sorted(mom):
            w = inv @ means[c]
            b = -0.5 * means[c] @ inv @ means[c] + math.log(mom[c][0] / n)
            score = sum((xi * float(wi) for xi, wi in zip(x, w)), F.lit(float(b)))
            cands.append(F.struct((-score).alias("s"), F.lit(c).alias("c")))
    else:
        for c in sorted(mom):
            m = mom[c][0]
            cov = scatter[c] / max(m - 1, 1)
            inv = np.linalg.pinv(cov)
            sign, logdet = np.linalg.slogdet(cov)
            logdet = logdet if sign > 0 else float(np.sum(np.log(np.clip(np.linalg.eigvalsh(cov), 1e-300, None))))
            diff = [xi - F.lit(float(mu)) for xi, mu in zip(x, means[c])]
            quad = sum((diff[i] * diff[j] * float(inv[i, j]) for i in range(len(x)) for j in range(len(x))),
                       F.lit(0.0))
            score = -0.5 * quad - 0.5 * logdet + math.log(m / n)
            cands.append(F.struct((-score).alias("s"), F.lit(c).alias("c")))
    return F.array_min(F.array(*cands))["c"]


# ---- M28: permutation importance ---------------------------------------------------------------

class AdditiveModel(NamedTuple):
    """A model whose score is a sum over the features: class c costs
    offset[c] + sum over f of weight[c][f] * (x_f - centre[c][f])^2 + slope[c][f] * x_f.
    The smallest cost wins, the smaller label among equals.  Classes ascend."""
    classes: list[str]
    centre: list[list[float]]
    weight: list[list[float]]
    slope: list[list[float]]
    offset: list[float]

    @classmethod
    def of_centroids(cls, centroids: dict) -> AdditiveModel:
        means = [[float(v) for v in centroids[c]] for c in sorted(centroids)]
        return cls(sorted(centroids), means, [[1.0] * len(m) for m in means], [[0.0] * len(m) for m in means], [0.0] * len(means))

    def term(self, c: int, f: int | Column, x: Column) -> Column:
        """What feature number f with value x adds to the cost of class number c."""
        def at(table):
            return F.lit(table[c][f]) if isinstance(f, int) else F.get(F.array(*[F.lit(v) for v in table[c]]), f)
        apart = x - at(self.centre)
        return at(self.weight) * (apart * apart) + at(self.slope) * x

    def winner(self, costs: list[Column]) -> Column:
        return F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(c).alias("c")) for d, c in zip(costs, self.classes)]))["c"]


def permutation_importance(test: DataFrame, features: list[str], model: AdditiveModel, n_repeats: int = 10,
                           seed: int = 0, key: str = "doc_id", label: str = "prof_level",
                           balanced: bool = False) -> DataFrame:
    """Importance of each feature = baseline score - score after permuting that feature's
    column, mean and population sd over repeats; ONE job for all (feature, repeat) pairs.

    The permutation of (feature f, repeat r) pairs row j (rank by key) with row j in
    md5(seed:r:f:key) order.  Both ranks are split (`range_rank`, `salted_rank`), so no task sorts the test
    rows.  A row travels once, with its class costs; each of its permuted values comes to it by
    rank as a row of one number and changes the costs by the feature's own term.  Keys are distinct numbers."""
    d = len(features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    costs = [sum((model.term(c, f, F.col(name).cast("double")) for f, name in enumerate(features)), F.lit(model.offset[c]))
             for c in range(len(model.classes))]
    rows = range_rank(test.select(key, F.col(label).alias("label"), x.alias("_x"), F.array(*costs).alias("_cost")), key, "_rn")
    pairs = F.array(*[F.struct(F.lit(f).alias("_f"), F.lit(r).alias("rep")) for f in range(d) for r in range(n_repeats)])
    given = test.select(key, x.alias("_x"), F.explode(pairs).alias("_fr")) \
                .select(key, "_fr._f", "_fr.rep", F.get("_x", F.col("_fr._f")).alias("_v"))
    names = F.array(*[F.lit(f) for f in features])
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.get(names, F.col("_f")), F.col(key).cast("string")))
    given = salted_rank(given, ["_f", "rep"], order, key, "_rn").drop(key)
    met = rows.join(given, "_rn")
    now = F.get("_x", F.col("_f"))
    swapped = [F.get("_cost", F.lit(c)) - model.term(c, F.col("_f"), now) + model.term(c, F.col("_f"), F.col("_v"))
               for c in range(len(model.classes))]
    hits = met.groupBy("_f", "rep", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == model.winner(swapped)).alias("h"))
    before = test.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == model.winner(costs)).alias("h"))
    score = F.avg(F.col("h") / F.col("n")) if balanced else F.sum("h") / F.sum("n")
    base = before.agg(score.alias("base")).first()["base"]  # one number: the baseline score of the fitted model
    drop = F.lit(base) - F.col("score")
    return hits.groupBy("_f", "rep").agg(score.alias("score")) \
        .groupBy(F.get(names, F.col("_f")).alias("feature")).agg(F.avg(drop).alias("importance_mean"), F.stddev_pop(drop).alias("importance_sd"))
