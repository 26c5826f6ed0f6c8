"""Reproducible samples, splits, shuffles and folds.

Randomness is a hash order, never `rand()`: a row's position is md5(seed ':' id), so the same
rows are chosen on every run, on every cluster size and in the SQL oracle.  Per-stratum
windows partition by the stratum keys; a stratum is at most a class of the label, and the
window sorts (spilling) rather than collecting it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, key: str, *salt: str) -> Column:
    parts = [F.lit(str(seed))] + [F.lit(s) for s in salt] + [F.col(key).cast("string")]
    return F.md5(F.concat_ws(":", *parts))


def _per_type_quota(df: DataFrame, n: int, label: str, stratum: str) -> DataFrame:
    """(label, _per): int(n / number of text types of the level); a missing type counts.
    One row per class: bounded by the label cardinality, so it is broadcast."""
    return df.groupBy(label).agg(
        (F.lit(n) / (F.count_distinct(stratum)
                     + F.max(F.col(stratum).isNull().cast("int")))).cast("int").alias("_per"))


def stratified_sample(df: DataFrame, level: str, n: int = 30, key: str = "doc_id",
                      seed: int = 0, label: str = "prof_level", stratum: str = "text_type") -> DataFrame:
    """M1: rows of one level, int(n / #types) per text type (a missing type counts in
    #types but is never sampled)."""
    return test_split(df, n, key, seed, (level,), (), label, stratum)


def simple_sample(df: DataFrame, level: str, n: int = 30, key: str = "doc_id", seed: int = 0,
                  label: str = "prof_level") -> DataFrame:
    """M2: n rows of one level, no stratification."""
    return test_split(df, n, key, seed, (), (level,), label)


def test_split(df: DataFrame, n: int = 30, key: str = "doc_id", seed: int = 0,
               stratified_levels=("A2", "B1", "B2"), simple_levels=("C1",),
               label: str = "prof_level", stratum: str = "text_type") -> DataFrame:
    """M1 + M2 + M3 in one pass: stratified levels take int(n / #types) rows per text type,
    simple levels take n rows; the union of all per-level samples."""
    quota = F.broadcast(_per_type_quota(df, n, label, stratum))
    order = [hash_order(seed, key), F.col(key)]
    strat = df.where(F.col(label).isin(list(stratified_levels)) & F.col(stratum).isNotNull())
    strat = strat.withColumn("_rn", F.row_number().over(Window.partitionBy(label, stratum).orderBy(*order)))
    # no quota exceeds n; a constant bound lets Spark cut each group before the shuffle
    strat = strat.where(F.col("_rn") <= n)
    strat = strat.join(quota, label).where(F.col("_rn") <= F.col("_per")).drop("_rn", "_per")
    simple = df.where(F.col(label).isin(list(simple_levels)))
    simple = simple.withColumn("_rn", F.row_number().over(Window.partitionBy(label).orderBy(*order))) \
                   .where(F.col("_rn") <= n).drop("_rn")
    return strat.select(*df.columns).unionByName(simple.select(*df.columns))


def train_split(df: DataFrame, test: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every row whose key is not in the test split (left anti join)."""
    return df.join(test.select(key), key, "left_anti")


def shuffled(df: DataFrame, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """M4: a reproducible shuffle: rows ordered by `shuffle_key` = md5(seed:id), a
    distributed range-partitioned sort (no global row numbers)."""
    return df.withColumn("shuffle_key", hash_order(seed, key)).orderBy("shuffle_key", key)


def hash_bucket(h: Column, hex_digits: int = 2) -> Column:
    """Bucket = leading hex digits of an md5 order key: monotone in the key, so ordering by
    (bucket, key) equals ordering by key."""
    return F.conv(F.substring(h, 1, hex_digits), 16, 10).cast("int")


def salted_rank(df: DataFrame, partition: list[str], order_key: Column, tie: str,
                out: str = "rank") -> DataFrame:
    """Exact `row_number() over (partition by … order by order_key, tie)` without sorting a
    whole (possibly huge) class in one task: rows are split into 256 buckets by the key
    prefix, ranked inside (partition, bucket), and shifted by the sizes of the earlier
    buckets (a tiny per-bucket count table)."""
    d = df.withColumn("_ok", order_key).withColumn("_bk", hash_bucket(F.col("_ok")))
    return _bucket_rank(d, partition, tie, out)


def range_rank(df: DataFrame, key: str, out: str = "rank", buckets: int = 256) -> DataFrame:
    """Exact `row_number() over (order by key)` for a numeric key, ranked in ranges of the key.
    The cuts between them (one row of `buckets` numbers) only set the size of the ranges; nulls come first."""
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = df.agg(F.percentile_approx(key, shares, 10_000)).first()[0] or []
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    return _bucket_rank(df.withColumn("_ok", F.col(key)).withColumn("_bk", F.when(F.col(key).isNull(), -1).otherwise(bucket)), [], key, out)


def _bucket_rank(d: DataFrame, partition: list[str], tie: str, out: str) -> DataFrame:
    """Rank by (_ok, tie), where _bk does not fall as _ok rises."""
    counts = d.groupBy(*partition, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*partition).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))).drop("_n")
    w = Window.partitionBy(*partition, "_bk").orderBy("_ok", tie)
    ranked = d.withColumn("_r", F.row_number().over(w))
    return (ranked.join(F.broadcast(offsets), [*partition, "_bk"])
            .withColumn(out, (F.col("_off") + F.col("_r")).cast("long"))
            .drop("_ok", "_bk", "_off", "_r"))


def stratified_folds(df: DataFrame, k: int = 10, key: str = "doc_id", label: str = "prof_level",
                     seed: int = 0) -> DataFrame:
    """M5: class-balanced folds: the i-th row of a class in md5(seed:fold:id) order goes to
    fold (i - 1) mod k.  Ranks come from `salted_rank`, so a class holding a third of all
    rows is still ranked by many tasks."""
    ranked = salted_rank(df, [label], hash_order(seed, key, "fold"), key, "_cls_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_cls_rank") - 1, F.lit(k)).cast("int")) \
                 .drop("_cls_rank")
