"""Plans for the classification studies over the driver documents.

Label = proficiency level (doc_id mod 4), strata = text type.  The labelled feature table is
checkpointed once into `spark.checkpoint.dir` (the cluster's shared folder), so the split,
the folds and every model read a short lineage.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators.models import AdditiveModel, fit, fit_centroids, fit_predict, permutation_importance
from ..operators.sampling import stratified_folds, test_split, train_split
from ..operators.selection import anova_f, fit_standardizer, select_k_best, standardize
from ..session import ensure_checkpoint_dir
from .corpus import document_features

# Feature set of the registered model queries: surface + lexical features of the feature table.
MODEL_FEATURES = ["word_count", "sent_count", "word_length", "sent_length", "SMOG", "syll_count",
                  "lemma_count", "RTTR", "CVV", "MTLD"]
TOP_K = 5
SEED = 0
FOLDS = 10


def labelled(spark: SparkSession, sf_dir: str, features: list[str] = MODEL_FEATURES,
             checkpoint: bool = True) -> DataFrame:
    """doc_id, prof_level, text_type and the model features; rows with a missing feature are
    skipped (as the vector assembler does)."""
    names = ["syllable_count" if f == "syll_count" else f for f in features]
    lookups = any(n in ("LD", "S_abstr") or n.startswith("rare_") for n in names)
    f = document_features(spark, sf_dir, names, with_lookups=lookups) \
        .withColumnRenamed("syllable_count", "syll_count")
    base = f.select("doc_id", "prof_level", "text_type", *features).dropna(subset=features)
    if checkpoint:
        ensure_checkpoint_dir(spark)
        base = base.checkpoint(eager=True)
    return base


def splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = labelled(spark, sf_dir)
    test = test_split(base, 30, "doc_id", SEED)
    return train_split(base, test), test


def scaled_splits(spark: SparkSession, sf_dir: str):
    train, test = splits(spark, sf_dir)
    params = fit_standardizer(train, MODEL_FEATURES)
    return standardize(train, params), standardize(test, params)


def selected(train_scaled: DataFrame, k: int = TOP_K) -> list[str]:
    """M8 result as a list (k names: a bounded model parameter)."""
    rows = select_k_best(anova_f(train_scaled, MODEL_FEATURES), k).orderBy("rank").collect()
    return [r["feature"] for r in rows]


def test_predictions(spark: SparkSession, sf_dir: str, model: str = "nearest_centroid"):
    tr, te = scaled_splits(spark, sf_dir)
    feats = selected(tr)
    keep = ("text_type",)
    predict = fit(model, tr, feats)
    return predict(te, keep=keep), predict(tr, keep=keep)


def oof_predictions(spark: SparkSession, sf_dir: str, model: str = "nearest_centroid") -> DataFrame:
    """Out-of-fold predictions over 10 class-balanced folds; scaling, top-k choice and model are
    fitted on the training folds of each fold."""
    from ..operators.cvmoments import cv_predictions
    train, _ = splits(spark, sf_dir)
    folded = stratified_folds(train, FOLDS, "doc_id", "prof_level", SEED).checkpoint(eager=True)
    return cv_predictions(folded, MODEL_FEATURES, [model], [TOP_K]).select("doc_id", "label", "prediction", "fold")


def cv_grid(spark: SparkSession, sf_dir: str, models: list[str], sizes: list[int],
            fast: bool = True) -> DataFrame:
    """For every (model, number of features): 10-fold CV where scaling, top-k selection
    and the model are refitted on the training folds of each fold (no leakage); one fit per
    fold, five metrics from the same out-of-fold predictions."""
    train, _ = splits(spark, sf_dir)
    folded = stratified_folds(train, FOLDS, "doc_id", "prof_level", SEED).checkpoint(eager=True)
    moment_models = [m for m in models if fast and m in ("nearest_centroid", "lda", "logistic_regression")]
    rows: list[DataFrame] = []
    if moment_models:
        from ..operators.cvmoments import cv_predictions
        rows.append(cv_predictions(folded, MODEL_FEATURES, moment_models, sizes))
    models = [m for m in models if m not in moment_models]

    def one_fold(k: int) -> list[DataFrame]:
        fit_rows = folded.where(F.col("fold") != k)
        held = folded.where(F.col("fold") == k)
        params = fit_standardizer(fit_rows, MODEL_FEATURES)
        fit_s, held_s = standardize(fit_rows, params), standardize(held, params)
        ranking = [r["feature"] for r in select_k_best(anova_f(fit_s, MODEL_FEATURES), len(MODEL_FEATURES))
                   .orderBy("rank").collect()]
        out = []
        for model in models:
            for size in sizes:
                p = fit_predict(model, fit_s, held_s, ranking[:size], keep=("fold",))
                out.append(p.withColumn("model", F.lit(model)).withColumn("n_features", F.lit(size)))
        return out

    # folds are independent: their (small) fitting jobs are submitted concurrently
    if models:
        with ThreadPoolExecutor(max_workers=4) as pool:
            rows += [p for part in pool.map(one_fold, range(FOLDS)) for p in part]
    allp = rows[0]
    for p in rows[1:]:
        allp = allp.unionByName(p)
    allp = allp.checkpoint(eager=True)
    hit = (F.col("label") == F.col("prediction")).cast("double")
    per_fold = allp.groupBy("model", "n_features", "fold").agg(F.avg(hit).alias("acc"))
    scores = per_fold.groupBy("model", "n_features").agg(F.avg("acc").alias("mean_accuracy"),
                                                          F.stddev_pop("acc").alias("sd_accuracy"))
    prf = ev._prf(ev.per_class(allp, ["model", "n_features", "fold"]), ["model", "n_features", "fold"])
    macro = prf.groupBy("model", "n_features", "fold").agg(F.avg("f1").alias("f"), F.avg("precision").alias("p"),
                                                           F.avg("recall").alias("r"))
    macro = macro.groupBy("model", "n_features").agg(
        F.avg("f").alias("f1_mean"), F.stddev_pop("f").alias("f1_sd"),
        F.avg("p").alias("precision_mean"), F.stddev_pop("p").alias("precision_sd"),
        F.avg("r").alias("recall_mean"), F.stddev_pop("r").alias("recall_sd"))
    return scores.join(macro, ["model", "n_features"])


def one_feature_discriminants(spark: SparkSession, sf_dir: str, feature: str = "lemma_count") -> DataFrame:
    """M15 and M16 on one feature: doc_id, label and both predictions for the test rows."""
    from ..operators.models import fit_discriminant
    tr, te = scaled_splits(spark, sf_dir)
    return te.select("doc_id", F.col("prof_level").alias("label"), fit_discriminant(tr, [feature]).alias("lda"),
                     fit_discriminant(tr, [feature], quadratic=True).alias("qda"))


#: Seed and rows per level of the second validation set.
SECOND_SEED, SECOND_ROWS = 1, 60


def second_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is left of the train rows, and a second validation set drawn from them whose levels differ in size:
    two are drawn in equal parts of their text types, two are not."""
    train, _ = splits(spark, sf_dir)
    second = test_split(train, SECOND_ROWS, "doc_id", SECOND_SEED, ("A2", "B2"), ("B1", "C1"))
    return train_split(train, second), second


def importance(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    """M28 + M29 + P6 with the nearest-centroid model on all model features: accuracy on the test rows,
    balanced accuracy on the second validation set."""
    tr, te = second_splits(spark, sf_dir) if second else splits(spark, sf_dir)
    params = fit_standardizer(tr, MODEL_FEATURES)
    tr, te = standardize(tr, params), standardize(te, params)
    model = AdditiveModel.of_centroids(fit_centroids(tr, MODEL_FEATURES))
    imp = permutation_importance(te, MODEL_FEATURES, model, n_repeats=10, seed=SEED, balanced=second)
    ranked = ev.rank_importances(imp)
    return ev.rename_labels(ranked.withColumn("display_name", F.col("feature")), "display_name")


def forward_selection(spark: SparkSession, sf_dir: str, m: int = 3) -> DataFrame:
    """M9: greedy forward selection by 5-fold CV accuracy of the nearest-centroid model.

    The fold statistics come from one moment aggregate; each greedy round scores every
    candidate subset on every fold in ONE pass (not one job per candidate and fold)."""
    from ..operators.cvmoments import centroid_rows, fold_moments, score_models
    tr, _ = scaled_splits(spark, sf_dir)
    folded = stratified_folds(tr, 5, "doc_id", "prof_level", SEED).checkpoint(eager=True)
    mom = fold_moments(folded, MODEL_FEATURES)
    chosen: list[str] = []
    steps = []
    hit = (F.col("label") == F.col("prediction")).cast("double")
    while len(chosen) < min(m, len(MODEL_FEATURES)):
        cands = [f for f in MODEL_FEATURES if f not in chosen]
        subsets = [chosen + [f] for f in cands]
        pred = score_models(folded, MODEL_FEATURES, centroid_rows(mom, MODEL_FEATURES, subsets))
        per_fold = pred.groupBy("n_features", "fold").agg(F.avg(hit).alias("acc"))
        scores = {r["n_features"]: r["s"] for r in per_fold.groupBy("n_features")
                  .agg(F.avg("acc").alias("s")).collect()}
        best = max(range(len(cands)), key=lambda i: (scores[i], -MODEL_FEATURES.index(cands[i])))
        chosen.append(cands[best])
        steps.append((len(chosen), cands[best], float(scores[best])))
    return _rows(spark, steps)


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    from ..operators.lookups import literal_table
    return literal_table(spark, rows, ["step", "feature", "cv_accuracy"])
