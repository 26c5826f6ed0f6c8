"""Metrics over a prediction table (key, label, prediction[, fold, type]).

Every metric is a `groupBy` over the prediction table: partial aggregation makes the size
of any class irrelevant, and the outputs are per-class / per-fold rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DISPLAY_NAMES


def _hit() -> F.Column:
    return (F.col("label") == F.col("prediction")).cast("double")


def accuracy(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of correct predictions (optionally per group)."""
    return pred.groupBy(*(by or [])).agg(F.avg(_hit()).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def recall_by_type(pred: DataFrame, level: str = "prof_level", text_type: str = "text_type") -> DataFrame:
    """Accuracy of each (level, text type) cell (grouped by column, not row position)."""
    return pred.groupBy(level, text_type).agg(F.avg(_hit()).alias("recall"),
                                              F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame) -> DataFrame:
    """M27 (long form): count per (true label, predicted label)."""
    return pred.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def per_class(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp / fp / fn / support per class (and group); a class seen only as a prediction
    still gets a row (support 0)."""
    by = by or []
    truth = pred.select(*by, F.col("label").alias("cls"), F.lit(1).alias("t"), _hit().alias("h"), F.lit(0).alias("p"))
    guess = pred.select(*by, F.col("prediction").alias("cls"), F.lit(0).alias("t"), F.lit(0.0).alias("h"), F.lit(1).alias("p"))
    u = truth.unionByName(guess)
    return u.groupBy(*by, "cls").agg(
        F.sum("h").cast("long").alias("tp"), F.sum("t").cast("long").alias("support"),
        F.sum("p").cast("long").alias("predicted")
    ).select(*by, "cls", "tp", "support", "predicted",
             (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"))


def _prf(pc: DataFrame, by: list[str]) -> DataFrame:
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    d = pc.select(*by, "cls", "support", p.alias("precision"), r.alias("recall"))
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
          .otherwise(F.lit(0.0))
    return d.withColumn("f1", f1)


def classification_report(pred: DataFrame) -> DataFrame:
    """Per class precision / recall / f1 / support, then `accuracy`, `macro avg` and
    `weighted avg` rows (zero_division = 0)."""
    prf = _prf(per_class(pred), [])
    classes = prf.select(F.col("cls").alias("row"), "precision", "recall", "f1",
                         F.col("support").cast("double").alias("support"))
    macro = prf.agg(F.lit("macro avg").alias("row"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"),
                    F.sum("support").cast("double").alias("support"))
    n = F.sum("support")
    weighted = prf.agg(F.lit("weighted avg").alias("row"),
                       (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"),
                       n.cast("double").alias("support"))
    acc = pred.agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.avg(_hit()).alias("f1"),
                   F.count(F.lit(1)).cast("double").alias("support"))
    return classes.unionByName(acc).unionByName(macro).unionByName(weighted)


def balanced_accuracy(pred: DataFrame) -> DataFrame:
    """Mean recall over the true classes."""
    per = pred.groupBy("label").agg(F.avg(_hit()).alias("recall"))
    return per.agg(F.avg("recall").alias("balanced_accuracy"))


def cv_scores(pred: DataFrame, fold: str = "fold") -> DataFrame:
    """Accuracy per fold, then mean and population sd over folds."""
    per = pred.groupBy(fold).agg(F.avg(_hit()).alias("acc"))
    return per.agg(F.avg("acc").alias("mean_accuracy"), F.stddev_pop("acc").alias("sd_accuracy"),
                   F.count(F.lit(1)).alias("folds"))


def macro_prf_per_fold(pred: DataFrame, fold: str = "fold") -> DataFrame:
    """Macro precision / recall / F1 per fold (classes in truth or prediction of the
    fold, undefined -> 0), then mean and population sd over folds."""
    prf = _prf(per_class(pred, [fold]), [fold])
    per_fold = prf.groupBy(fold).agg(F.avg("precision").alias("p"), F.avg("recall").alias("r"),
                                     F.avg("f1").alias("f"))
    return per_fold.agg(
        F.avg("f").alias("f1_mean"), F.stddev_pop("f").alias("f1_sd"),
        F.avg("p").alias("precision_mean"), F.stddev_pop("p").alias("precision_sd"),
        F.avg("r").alias("recall_mean"), F.stddev_pop("r").alias("recall_sd"))


def rename_labels(df: DataFrame, col: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Display names for reporting (unmapped values unchanged)."""
    mapping = mapping or DISPLAY_NAMES
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(col, F.coalesce(F.element_at(m, F.col(col)), F.col(col)))


def rank_importances(imp: DataFrame) -> DataFrame:
    """Features in ascending order of mean importance (rank 1 = least important).
    Means that agree to 12 digits are ties, which go by name, as sums of shares differ in the last bits.
    The table has one row per feature, so the global window is tiny."""
    w = Window.orderBy(F.round("importance_mean", 12), F.col("feature"))
    return imp.withColumn("rank", F.row_number().over(w))
