"""Logistic regression by Newton steps: each step is one distributed pass that sums a small gradient and Hessian.

Features are standardized by their population deviation (1 where it is almost zero). The loss is the mean log-loss plus
lambda / 2 times the squared coefficients without the intercept. Only sums of the size of the Hessian reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TINY, STEPS, CLOSE = 1e-12, 100, 1e-9


@dataclass(frozen=True)
class Fit:
    features: list[str]
    means: np.ndarray
    scales: np.ndarray
    beta: np.ndarray  # intercept first
    converged: bool
    steps: int

    def probability(self):
        """Column of probabilities, clipped to [1e-6, 1 - 1e-6]."""
        z = F.lit(float(self.beta[0]))
        for f, m, s, b in zip(self.features, self.means, self.scales, self.beta[1:], strict=True):
            z = z + (F.col(f).cast("double") - float(m)) / float(s) * float(b)
        return F.least(F.greatest(1 / (1 + F.exp(-z)), F.lit(1e-6)), F.lit(1 - 1e-6))


def _sums(df: DataFrame, features: list[str], target: str, means, scales, beta) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(n, loss, gradient, Hessian) as plain sums over all rows."""
    width = len(features) + 1

    def run(batches):
        n, loss, g, h = 0.0, 0.0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = np.column_stack([np.ones(batch.num_rows), *[(c.to_numpy(zero_copy_only=False) - m) / s for c, m, s in zip(batch.columns[1:], means, scales, strict=True)]])
            y, z = batch.columns[0].to_numpy(zero_copy_only=False), x @ beta
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            n += len(y)
            loss += float(np.sum(np.logaddexp(0, z) - y * z))
            g += x.T @ (p - y)
            h += (x * (p * (1 - p))[:, None]).T @ x
        yield pa.RecordBatch.from_arrays([pa.array([[n, loss, *g, *h.ravel()]], pa.list_(pa.float64()))], names=["sums"])

    narrow = df.select(F.col(target).cast("double"), *[F.col(f).cast("double") for f in features])
    size = 2 + width + width * width
    sums = narrow.mapInArrow(run, "sums array<double>").agg(*[F.sum(F.col("sums")[i]) for i in range(size)]).first()
    v = np.array([x or 0.0 for x in sums])
    return v[0], v[1], v[2 : 2 + width], v[2 + width :].reshape(width, width)


def fit(df: DataFrame, features: list[str], target: str, penalty: float) -> Fit:
    stats = df.agg(*[F.avg(F.col(f).cast("double")) for f in features], *[F.stddev_pop(F.col(f).cast("double")) for f in features]).first()
    means = np.array([x or 0.0 for x in stats[: len(features)]])
    scales = np.array([x if x and x > TINY else 1.0 for x in stats[len(features) :]])
    beta, weight = np.zeros(len(features) + 1), np.r_[0.0, np.full(len(features), penalty)]

    def objective(n, loss, at):
        return loss / n + 0.5 * float(weight @ (at * at))

    n, loss, g, h = _sums(df, features, target, means, scales, beta)
    if not n:
        raise ValueError("no rows to fit")
    for step in range(1, STEPS + 1):
        move = np.linalg.solve(h / n + np.diag(np.r_[TINY, weight[1:]]), g / n + weight * beta)
        size = 1.0
        while True:
            new = beta - size * move
            n2, loss2, g2, h2 = _sums(df, features, target, means, scales, new)
            if objective(n2, loss2, new) <= objective(n, loss, beta) + 1e-15 or size <= 1 / 1024:
                break
            size /= 2
        change = float(np.max(np.abs(new - beta)))
        beta, loss, g, h = new, loss2, g2, h2
        if change <= CLOSE:
            return Fit(features, means, scales, beta, True, step)
    return Fit(features, means, scales, beta, False, STEPS)


@dataclass
class Metrics:
    """Counts and means of a split; means have twelve digits, halves go to the even one."""

    n: int
    decisive: int
    correct: int
    mean_brier: Decimal
    mean_log_loss: Decimal
    accuracy: Decimal | None


@dataclass
class Selection:
    penalty: float
    candidates: list[tuple[float, Fit, Metrics]]  # penalty, fit on the training rows, validation metrics
    final: Fit  # on training and validation rows
    test: Metrics


def twelve(x: float) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.000000000001"), ROUND_HALF_EVEN)


def complete(df: DataFrame, features: list[str], target: str, *others: str) -> DataFrame:
    """The columns in use as doubles, of rows that have them all."""
    narrow = df.select(*others, F.col(target).cast("double").alias(target), *[F.col(f).cast("double").alias(f) for f in features])
    return narrow.dropna(subset=[target, *features])


def fit_all(df: DataFrame, features: list[str], target: str, penalties: list[float]) -> list[Fit]:
    """fit() for several penalties at once: each pass over the rows serves the next trial of every penalty that has not converged.

    df: complete() rows, which are read once a pass.
    """
    stats = df.agg(*[F.avg(f) for f in features], *[F.stddev_pop(f) for f in features]).first()
    means = np.array([x or 0.0 for x in stats[: len(features)]])
    scales = np.array([x if x and x > TINY else 1.0 for x in stats[len(features) :]])
    width = len(features) + 1
    weights = [np.r_[0.0, np.full(width - 1, penalty)] for penalty in penalties]

    def sums(betas: list[np.ndarray]) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
        def run(batches):
            total = np.zeros((len(betas), 2 + width + width * width))
            for batch in batches:
                columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
                x = np.column_stack([np.ones(batch.num_rows), *[(c - m) / s for c, m, s in zip(columns[1:], means, scales, strict=True)]])
                for out, beta in zip(total, betas, strict=True):
                    z = x @ beta
                    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                    out += np.r_[len(z), np.sum(np.logaddexp(0, z) - columns[0] * z), x.T @ (p - columns[0]), ((x * (p * (1 - p))[:, None]).T @ x).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

        size = 2 + width + width * width
        found = df.select(target, *features).mapInArrow(run, "sums array<double>").agg(*[F.sum(F.col("sums")[i]) for i in range(size * len(betas))]).first()
        rows = np.array([x or 0.0 for x in found]).reshape(len(betas), size)
        return [(r[0], r[1], r[2 : 2 + width], r[2 + width :].reshape(width, width)) for r in rows]

    def objective(k: int, n: float, loss: float, at: np.ndarray) -> float:
        return loss / n + 0.5 * float(weights[k] @ (at * at))

    betas = [np.zeros(width) for _ in penalties]
    now = sums(betas[:1]) * len(penalties)
    if not now[0][0]:
        raise ValueError("no rows to fit")
    done: dict[int, Fit] = {}
    steps, moves, sizes = [0] * len(penalties), [None] * len(penalties), [1.0] * len(penalties)
    while active := [k for k in range(len(penalties)) if k not in done]:
        for k in active:
            if moves[k] is None:
                n, _, g, h = now[k]
                moves[k] = np.linalg.solve(h / n + np.diag(np.r_[TINY, weights[k][1:]]), g / n + weights[k] * betas[k])
                sizes[k] = 1.0
                steps[k] += 1
        trials = [betas[k] - sizes[k] * moves[k] for k in active]
        for k, new, found in zip(active, trials, sums(trials), strict=True):
            better = objective(k, found[0], found[1], new) <= objective(k, now[k][0], now[k][1], betas[k]) + 1e-15
            if not better and sizes[k] > 1 / 1024:
                sizes[k] /= 2
                continue
            change = float(np.max(np.abs(new - betas[k])))
            betas[k], now[k], moves[k] = new, found, None
            if change <= CLOSE or steps[k] == STEPS:
                done[k] = Fit(features, means, scales, new, change <= CLOSE, steps[k])
    return [done[k] for k in range(len(penalties))]


def metrics(df: DataFrame, found: Fit, target: str) -> Metrics:
    """Of complete() rows. A probability of exactly one half is no prediction."""
    p, y = found.probability(), F.col(target)
    decisive = p != 0.5
    right = decisive & ((p > 0.5) == (y == 1))
    row = df.agg(F.count(F.lit(1)), F.count_if(decisive), F.count_if(right), F.avg((p - y) * (p - y)), F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))).first()
    if not row[0]:
        raise ValueError("no rows to measure")
    return Metrics(row[0], row[1], row[2], twelve(row[3]), twelve(row[4]), twelve(row[2] / row[1]) if row[1] else None)


def select(rows: DataFrame, features: list[str], target: str, split: str, penalties: list[float]) -> Selection:
    """Fit every penalty on the rows of split "train", take the converged one with the least Brier score over "validation" (of equals the largest
    penalty), fit it anew on both, and measure it on "test". Rows without a feature or target take no part. Rows are kept for the passes and let go after."""
    kept = complete(rows, features, target, split).persist()
    try:
        of = lambda *names: kept.filter(F.col(split).isin(*names))
        if len(of("train").select(target).distinct().take(2)) < 2:
            raise ValueError("the training rows lack one of the outcomes")
        fits = fit_all(of("train"), features, target, penalties)
        candidates = [(penalty, found, metrics(of("validation"), found, target)) for penalty, found in zip(penalties, fits, strict=True)]
        converged = [c for c in candidates if c[1].converged]
        if not converged:
            raise ValueError("no penalty converged")
        penalty = min(converged, key=lambda c: (c[2].mean_brier, -c[0]))[0]
        (final,) = fit_all(of("train", "validation"), features, target, [penalty])
        if not final.converged:
            raise ValueError("the last fit did not converge")
        return Selection(penalty, candidates, final, metrics(of("test"), final, target))
    finally:
        kept.unpersist()
