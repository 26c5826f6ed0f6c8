"""Mergeable centred co-moments: n, mean and scatter of a group's feature vectors.

Raw sums of squares cancel when means are large against deviations, and d(d+1)/2 sum expressions
grow with the square of the features.  Here each task keeps (n, mean, scatter) of its groups, as
vectors, and two of them merge by the pairwise formula (Chan, Golub, LeVeque), first batch by batch in the
task and then group by group behind one exchange of a row for each task and group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n, mean, scatter (sum of outer products of the deviations)
Moments = tuple[float, np.ndarray, np.ndarray]


def moments_of(x: np.ndarray) -> Moments:
    mean = x.mean(0)
    centred = x - mean
    return float(len(x)), mean, centred.T @ centred


def merge(a: Moments | None, b: Moments) -> Moments:
    if a is None:
        return b
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def as_matrix(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows of an array column of d doubles each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("part", pa.int32()), ("cls", pa.string()), ("n", pa.float64()), ("mean", pa.binary()), ("scatter", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], names=[k for k, _ in kinds])


def grouped_moments(df: DataFrame, features: list[str], label: str, part: str | None = None) -> dict[tuple, Moments]:
    """{(part, class): moments} of all rows; parts x classes x features squared reach the driver."""
    d = len(features)
    rows = df.select((F.col(part).cast("int") if part else F.lit(0)).alias("part"), F.col(label).cast("string").alias("cls"),
                     F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    schema = "part int, cls string, n double, mean binary, scatter binary"

    def in_task(batches):
        held: dict = {}
        for batch in batches:
            parts, classes = batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist(), object)
            x = as_matrix(batch.column(2), d)
            for key in set(zip(parts.tolist(), classes.tolist())):
                mine = (parts == key[0]) & (classes == key[1])
                held[key] = merge(held.get(key), moments_of(x[mine]))
        if held:
            yield _packed([(*k, n, mean.tobytes(), scatter.tobytes()) for k, (n, mean, scatter) in held.items()])

    def of_group(key, batches):
        total = None
        for batch in batches:
            for n, mean, scatter in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "scatter"))):
                total = merge(total, (n, np.frombuffer(mean), np.frombuffer(scatter).reshape(d, d)))
        yield _packed([(key[0].as_py(), key[1].as_py(), total[0], total[1].tobytes(), total[2].tobytes())])

    merged = rows.mapInArrow(in_task, schema).groupBy("part", "cls").applyInArrow(_typed(of_group), schema)
    return {(r["part"], r["cls"]): (r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["scatter"]).reshape(d, d))
            for r in merged.collect()}


def _typed(fn):
    """The signature from which Spark takes the kind of a grouped function."""
    from collections.abc import Iterator
    from typing import Tuple  # noqa: UP035

    def run(key, batches):
        yield from fn(key, batches)
    run.__annotations__ = {"key": Tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return run
