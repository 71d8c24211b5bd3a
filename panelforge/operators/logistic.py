"""Logistic regression with an L2 penalty over vectors of any table, by Newton steps of one pass each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.operators.models import _add, _pass
from panelforge.operators.order import checkpointed


@dataclass(frozen=True)
class Logistic:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    rounds: int

    def probability(self) -> Column:
        """The predicted probability from the feature columns; null where one is null."""
        z = F.lit(self.intercept)
        for name, w in zip(self.features, self.weights, strict=True):
            z = z + F.col(name).cast("double") * w
        return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def fitted(df: DataFrame, features: list[str], truth: str, c: float = 1.0, rounds: int = 100, tolerance: float = 1e-9) -> Logistic:
    """The minimum of w.w / 2 + c * (sum of log losses); the intercept is free.

    truth: 0 or 1; rows without it or with a feature that is not finite are left out. Every round is one pass that sums loss,
    gradient and Hessian, (d + 1)(d + 3) numbers, halving the step where the last one did not lower the objective. Truths
    of one kind give a constant: their rate, with weights of nought.
    """
    ok = [F.col(x).isNotNull() & (F.abs(F.col(x).cast("double")) < float("inf")) for x in features]
    rows = df.filter(F.col(truth).isin(0, 1))
    for some in ok:
        rows = rows.filter(some)
    data = checkpointed(rows.select(F.lit(0).cast("long").alias("key"), F.array(F.col(truth).cast("double"), *[F.col(x).cast("double") for x in features]).alias("x")))
    d = len(features)
    count = _pass(data, lambda _, x: np.array([len(x), x[:, 0].sum()]), _add)
    if count is None or count[1] in (0, count[0]):
        rate = None if count is None else count[1] / count[0]
        return Logistic(tuple(features), (0.0,) * d, 0.0 if rate is None else float("inf") if rate == 1 else float("-inf"), 0)
    penalty = np.append(np.ones(d), 0.0)

    def measured(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(_: np.ndarray, x: np.ndarray) -> np.ndarray:
            y, z = x[:, 0], np.column_stack([x[:, 1:], np.ones(len(x))])
            t = z @ beta
            p = np.where(t >= 0, 1 / (1 + np.exp(-np.abs(t))), np.exp(-np.abs(t)) / (1 + np.exp(-np.abs(t))))
            loss = np.maximum(t, 0) - t * y + np.log1p(np.exp(-np.abs(t)))
            return np.concatenate([[loss.sum()], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        got = _pass(data, sums, _add)
        return c * got[0] + (penalty * beta**2).sum() / 2, c * got[1 : d + 2] + penalty * beta, c * got[d + 2 :].reshape(d + 1, d + 1) + np.diag(penalty)

    beta = np.zeros(d + 1)
    now, gradient, hessian = measured(beta)
    step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    for turn in range(1, rounds + 1):
        tried, g, h = measured(beta - step)
        if tried > now + 1e-12 * abs(now):
            step = step / 2
            continue
        beta, now, gradient, hessian = beta - step, tried, g, h
        if np.abs(step).max() < tolerance or np.abs(gradient).max() < tolerance:
            break
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    return Logistic(tuple(features), tuple(map(float, beta[:-1])), float(beta[-1]), turn)
