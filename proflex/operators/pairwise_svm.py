"""A support vector classifier with an RBF kernel, one machine for each pair of classes.

Spark has no kernel machine.  The kernel exp(-gamma |x - y|^2) is approximated by random Fourier
features (Rahimi & Recht 2007), z(x) = sqrt(2/D) cos(W x + b) with W ~ N(0, 2 gamma), b ~ U(0, 2 pi), and each
pair of classes has a linear machine over z: |w|^2 / 2 + C * sum of squared hinge losses, the intercept
unpenalised.  All pairs are trained together: one pass over the rows gives loss and gradient of every
pair, and the driver holds the pairs' weights (classes squared x D).  A row goes to the class that wins
most pairs, the smaller label among equals.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .comoments import _typed, as_matrix
from .logistic_grid import MAX_ITER, Problem

DIM = 200       # random Fourier features
LANES = 64      # rows that meet on the driver after each pass


@dataclass
class PairwiseSVM:
    classes: list[str]
    pairs: list[tuple[int, int]]
    project: np.ndarray     # D x d
    phase: np.ndarray       # D
    weights: np.ndarray     # pairs x (D + 1)
    converged: bool

    def labels(self, x: np.ndarray) -> np.ndarray:
        margins = fourier(x, self.project, self.phase) @ self.weights.T
        votes = np.zeros((len(x), len(self.classes)), int)
        for i, (a, b) in enumerate(self.pairs):
            won = margins[:, i] > 0
            votes[:, a] += won
            votes[:, b] += ~won
        return np.array(self.classes, object)[votes.argmax(1)]

    def column(self, features: list[str]) -> Column:
        """The predicted label; null where a feature is missing."""
        d, model = len(features), self

        @F.pandas_udf(T.StringType())
        def predict(rows: pd.Series) -> pd.Series:
            known = rows.notna()
            out = pd.Series([None] * len(rows), index=rows.index, dtype=object)
            if known.any():
                out[known] = model.labels(np.vstack(rows[known].to_numpy()).reshape(-1, d))
            return out
        x = [F.col(f).cast("double") for f in features]
        return predict(F.when(known_rows(features), F.array(*x)))


def known_rows(features: list[str]) -> Column:
    out = F.lit(True)
    for f in features:
        out = out & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    return out


def fourier(x: np.ndarray, project: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Kernel features of the rows, and a one for the intercept."""
    z = np.sqrt(2.0 / len(phase)) * np.cos(x @ project.T + phase)
    return np.column_stack([z, np.ones(len(x))])


def hinge(z: np.ndarray, y: np.ndarray, pairs: list[tuple[int, int]], trials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the squared hinge loss and of its gradient for each pair over the rows of its classes."""
    a, b = np.array(pairs).T
    sign = (y[:, None] == a).astype(float) - (y[:, None] == b)
    short = np.where(sign != 0, np.maximum(1.0 - sign * (z @ trials.T), 0.0), 0.0)
    return (short ** 2).sum(0), (-2.0 * sign * short).T @ z


def fit_pairwise(train: DataFrame, features: list[str], label: str = "prof_level", c: float = 1.0, gamma: float | None = None,
                 dim: int = DIM, seed: int = 0, max_iter: int = MAX_ITER) -> PairwiseSVM:
    """Fit on rows whose features are standardised; rows with a missing feature or label are left out."""
    d = len(features)
    rng = np.random.default_rng(seed)
    gamma = 1.0 / d if gamma is None else gamma
    project, phase = rng.normal(0.0, np.sqrt(2 * gamma), (dim, d)), rng.uniform(0, 2 * np.pi, dim)
    known = train.where(known_rows(features) & F.col(label).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    classes = sorted(sizes)
    pairs = list(combinations(range(len(classes)), 2))
    if not pairs:
        return PairwiseSVM(classes, [], project, phase, np.zeros((0, dim + 1)), True)
    number = F.array_position(F.array(*[F.lit(k) for k in classes]), F.col(label)) - 1
    packed = known.select(number.cast("int").alias("y"), F.array(*[F.col(f).cast("double") for f in features]).alias("x")) \
                  .checkpoint(eager=True)
    problems = [Problem(None, np.ones(dim), np.zeros(dim), np.ones(dim), sizes[classes[a]] + sizes[classes[b]], c) for a, b in pairs]
    for p in problems:
        p.start(1)
    schema = "lane int, loss binary, gradient binary"
    spark = train.sparkSession
    for _ in range(max_iter):
        open_ = [i for i, p in enumerate(problems) if p._trial is not None]
        if not open_:
            break
        told = spark.sparkContext.broadcast(([pairs[i] for i in open_], np.vstack([problems[i]._trial for i in open_])))

        def in_task(batches, told=told):
            from pyspark import TaskContext
            mine, trials = told.value
            total = None
            for batch in batches:
                z = fourier(as_matrix(batch.column(1), d), project, phase)
                part = hinge(z, batch.column(0).to_numpy(), mine, trials)
                total = part if total is None else (total[0] + part[0], total[1] + part[1])
            if total is not None:
                yield _row(TaskContext.get().partitionId() % LANES, *total)

        def add(key, batches):
            loss = gradient = 0.0
            for batch in batches:
                for lo, gr in zip(batch.column("loss").to_pylist(), batch.column("gradient").to_pylist()):
                    loss, gradient = loss + np.frombuffer(lo), gradient + np.frombuffer(gr)
            yield _row(key[0].as_py(), loss, gradient)

        # at most LANES rows of the size of the weights, however many tasks there are
        sums = packed.mapInArrow(in_task, schema).groupBy("lane").applyInArrow(_typed(add), schema).collect()
        loss = sum(np.frombuffer(r["loss"]) for r in sums)
        gradient = sum(np.frombuffer(r["gradient"]) for r in sums).reshape(len(open_), 1, dim + 1)
        for j, i in enumerate(open_):
            problems[i].observe(float(loss[j]), gradient[j].copy())
        told.destroy()
    for p in problems:
        if p._trial is not None:
            p.weights = p._at
    return PairwiseSVM(classes, pairs, project, phase, np.vstack([p.weights for p in problems]), all(p.converged for p in problems))


def _row(lane: int, loss: np.ndarray, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lane], pa.int32()), pa.array([loss.tobytes()], pa.binary()),
                                       pa.array([gradient.tobytes()], pa.binary())], names=["lane", "loss", "gradient"])
