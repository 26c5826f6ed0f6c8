"""Many multinomial logistic regressions fitted together.

A problem is a fold (its rows are left out), a set of features, the scaling and a penalty.  All
problems of a grid share the rows, so one pass over them gives loss and gradient of every problem at
its current point: each task turns a batch into one matrix product for each fold, and the sums of the
tasks meet behind one exchange of a row for each task and fold.  The driver holds the parameters
(problems x classes x features, the size of the answer) and moves each problem by its own L-BFGS
step with backtracking, until its gradient is below TOL or MAX_ITER passes were made; a problem that
ends without convergence is reported.

The objective is mean log-loss + |W|^2 / (2 C n), the intercepts unpenalised, on standardised features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .comoments import _typed, as_matrix

TOL = 1e-5          # of the mean objective's gradient
MAX_ITER = 10_000
MEMORY = 10
ARMIJO = 1e-4


@dataclass
class Problem:
    """One fit; `fold` None leaves no row out.  `weights` is classes x (features + 1) when fitted."""
    fold: int | None
    mask: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    n: float
    c: float = 1.0
    weights: np.ndarray | None = None
    converged: bool = False
    passes: int = 0
    _steps: list = field(default_factory=list)

    def penalty(self, w: np.ndarray) -> tuple[float, np.ndarray]:
        pulled = w.copy()
        pulled[:, -1] = 0.0
        return float((pulled ** 2).sum()) / (2 * self.c * self.n), pulled / (self.c * self.n)

    def start(self, classes: int) -> None:
        self.weights = np.zeros((classes, len(self.mask) + 1))
        self._at = self._trial = self.weights
        self._loss = self._gradient = self._direction = None

    def observe(self, loss: float, gradient: np.ndarray) -> None:
        """Take loss and gradient (sums over the rows) at the trial point and choose the next."""
        extra, pull = self.penalty(self._trial)
        loss, gradient = loss / self.n + extra, gradient / self.n + pull
        gradient[:, :-1] *= self.mask
        self.passes += 1
        if self._direction is not None:
            if not loss <= self._loss + ARMIJO * self._length * float((self._direction * self._gradient).sum()):
                self._length *= 0.5
                if self._length < 1e-12:
                    self.weights, self.converged = self._at, np.abs(self._gradient).max() <= 100 * TOL
                    self._trial = None
                    return
                self._trial = self._at + self._length * self._direction
                return
            s, y = self._trial - self._at, gradient - self._gradient
            if float((s * y).sum()) > 1e-14:
                self._steps = [*self._steps[1 - MEMORY:], (s, y, 1.0 / float((s * y).sum()))]
        self._at, self._loss, self._gradient = self._trial, loss, gradient
        if np.abs(gradient).max() <= TOL:
            self.weights, self.converged, self._trial = self._at, True, None
            return
        self._direction, self._length = -self._newton(gradient), 1.0
        self._trial = self._at + self._direction

    def _newton(self, gradient: np.ndarray) -> np.ndarray:
        """The inverse Hessian of the last steps times the gradient (two loops)."""
        q, used = gradient.copy(), []
        for s, y, rho in reversed(self._steps):
            a = rho * float((s * q).sum())
            q -= a * y
            used.append(a)
        if self._steps:
            s, y, rho = self._steps[-1]
            q /= rho * float((y * y).sum())
        for (s, y, rho), a in zip(self._steps, reversed(used)):
            q += s * (a - rho * float((y * q).sum()))
        return q

    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights (classes x features) and intercepts for features that are not standardised."""
        w = self.weights[:, :-1] * self.mask / self.sd
        return w, self.weights[:, -1] - w @ self.mean


def loss_and_gradient(x: np.ndarray, y: np.ndarray, problems: list[Problem], trials: list[np.ndarray]):
    """Sums of loss and gradient over the rows for problems that share fold and scaling."""
    classes = trials[0].shape[0]
    z = np.column_stack([(x - problems[0].mean) / problems[0].sd, np.ones(len(x))])
    scores = (z @ np.vstack(trials).T).reshape(len(x), len(trials), classes)
    top = scores.max(2, keepdims=True)
    shares = np.exp(scores - top)
    total = shares.sum(2, keepdims=True)
    own = np.take_along_axis(scores, y[:, None, None], 2)
    losses = (np.log(total) + top - own).sum(0)[:, 0]
    shares /= total
    shares[np.arange(len(x)), :, y] -= 1.0
    return losses, (shares.reshape(len(x), -1).T @ z).reshape(len(trials), classes, -1)


def fit_logistic(rows: DataFrame, features: list[str], classes: list[str], problems: list[Problem], label: str = "prof_level",
                 fold: str | None = None, max_iter: int = MAX_ITER) -> list[Problem]:
    """Fit all problems on `rows`; each pass is one job over the rows."""
    d, spark = len(features), rows.sparkSession
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    packed = rows.select(number.cast("int").alias("y"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
                         F.array(*[F.col(f).cast("double") for f in features]).alias("x")).where("y >= 0").checkpoint(eager=True)
    for p in problems:
        p.start(len(classes))
    schema = "lead int, losses binary, gradients binary"
    for _ in range(max_iter):
        # problems of a fold with the same scaling are one product, told apart by the first of them
        teams: dict = {}
        for i, p in enumerate(problems):
            if p._trial is not None:
                teams.setdefault((p.fold, p.mean.tobytes(), p.sd.tobytes()), []).append(i)
        if not teams:
            break
        told = spark.sparkContext.broadcast({team[0]: ([problems[i] for i in team], [problems[i]._trial for i in team]) for team in teams.values()})

        def in_task(batches, told=told):
            sums: dict = {}
            for batch in batches:
                y, folds, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), as_matrix(batch.column(2), d)
                for lead, (team, trials) in told.value.items():
                    kept = folds != team[0].fold if team[0].fold is not None else slice(None)
                    loss, gradient = loss_and_gradient(x[kept], y[kept].astype(np.int64), team, trials)
                    sums[lead] = (sums[lead][0] + loss, sums[lead][1] + gradient) if lead in sums else (loss, gradient)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0].tobytes() for s in sums.values()], pa.binary()),
                                                  pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], names=["lead", "losses", "gradients"])

        def add(key, batches):
            total = None
            for batch in batches:
                for losses, gradients in zip(batch.column("losses").to_pylist(), batch.column("gradients").to_pylist()):
                    part = np.frombuffer(losses), np.frombuffer(gradients)
                    total = part if total is None else (total[0] + part[0], total[1] + part[1])
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total[0].tobytes()], pa.binary()),
                                              pa.array([total[1].tobytes()], pa.binary())], names=["lead", "losses", "gradients"])

        # as many rows as there are folds, of the size of their problems' parameters
        for r in packed.mapInArrow(in_task, schema).groupBy("lead").applyInArrow(_typed(add), schema).collect():
            team = next(t for t in teams.values() if t[0] == r["lead"])
            losses = np.frombuffer(r["losses"])
            gradients = np.frombuffer(r["gradients"]).reshape(len(team), len(classes), d + 1)
            for i, loss, gradient in zip(team, losses, gradients):
                problems[i].observe(float(loss), gradient.copy())
        told.destroy()
    for p in problems:
        if p._trial is not None:
            p.weights = p._at
    return problems
