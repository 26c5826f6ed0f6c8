"""M6-M9: standardisation, ANOVA F, top-k and sequential forward selection.

Fitted parameters (means, deviations, F scores) are one aggregate over the data: a single
pass with map-side partial aggregation, whatever the size of any class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_standardizer(train: DataFrame, features: list[str]) -> dict[str, tuple[float, float]]:
    """M6 fit: mean and population sd per feature (sd 0 -> scale 1). One aggregate job;
    the result is a model parameter of size #features."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}")]
    row = train.agg(*aggs).first()
    return {f: (row[f"m_{f}"], row[f"s_{f}"] if row[f"s_{f}"] else 1.0) for f in features}


def standardize(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    """M6 apply: (x - mean) / sd as column arithmetic."""
    cols = [((F.col(f) - F.lit(m)) / F.lit(s)).alias(f) if f in params else F.col(f)
            for f, (m, s) in ((c, params.get(c, (0.0, 1.0))) for c in df.columns)]
    return df.select(*cols)


def anova_f(df: DataFrame, features: list[str], label: str = "prof_level") -> DataFrame:
    """M7: one-way ANOVA F per feature: (SSB/(k-1)) / (SSW/(n-k)).

    One `groupBy(label)` of n, Σx, Σx² per feature (partial aggregation, so a huge class
    costs nothing extra), then per feature arithmetic over k class rows."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for f in features:
        aggs += [F.sum(f).alias(f"s_{f}"), F.sum(F.col(f) * F.col(f)).alias(f"q_{f}")]
    per_class = df.groupBy(label).agg(*aggs)
    stacked = per_class.select(
        label, "n",
        F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"s_{f}").alias("s"),
                                     F.col(f"q_{f}").alias("q")) for f in features])).alias("v"))
    totals = stacked.groupBy(F.col("v.feature").alias("feature")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum("v.s").alias("s"), F.sum("v.q").alias("q"),
        F.sum(F.col("v.s") * F.col("v.s") / F.col("n")).alias("between"))
    ssb = F.col("between") - F.col("s") * F.col("s") / F.col("n")
    ssw = F.col("q") - F.col("between")
    return totals.select("feature", F.try_divide(ssb / (F.col("k") - 1), ssw / (F.col("n") - F.col("k")))
                         .alias("f_score"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """M8: the k features with the highest F (ties by name), with their rank."""
    w = Window.orderBy(F.col("f_score").desc_nulls_last(), F.col("feature"))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
