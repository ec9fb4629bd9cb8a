"""Selection of a penalty against Newton's method in numpy, and rows that lack a value."""

import numpy as np
import pytest

from ledgerlark.operators import logistic

PENALTIES = [0.001, 0.01, 0.1, 1.0]


def made(seed=3, n=600):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 10, 1]
    z = 0.8 * x[:, 0] - 0.2 * (x[:, 1] - 10) + 3 * (x[:, 2] - 1)
    y = (r.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    split = np.array(["train", "validation", "test"])[r.choice(3, n, p=[0.5, 0.3, 0.2])]
    return x, y, split


def newton(x, y, penalty):
    means, scales = x.mean(0), x.std(0)
    a = np.column_stack([np.ones(len(x)), (x - means) / scales])
    beta, weight = np.zeros(4), np.r_[0, np.full(3, penalty)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ beta))
        beta = beta - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a / len(y) + np.diag(np.r_[1e-12, weight[1:]]), a.T @ (p - y) / len(y) + weight * beta)
    return means, scales, beta


def scores(x, y, found):
    means, scales, beta = found
    p = np.clip(1 / (1 + np.exp(-np.column_stack([np.ones(len(x)), (x - means) / scales]) @ beta)), 1e-6, 1 - 1e-6)
    return np.mean((p - y) ** 2), np.mean(-(y * np.log(p) + (1 - y) * np.log(1 - p))), int(np.sum((p > 0.5) == (y == 1)))


def frame(spark, x, y, split):
    rows = [(*map(float, a), int(b), str(c)) for a, b, c in zip(x, y, split, strict=True)]
    return spark.createDataFrame(rows + [(None, 1.0, 1.0, 1, "train"), (1.0, 1.0, 1.0, None, "test"), (1.0, 1.0, 1.0, 1, None)], "a double, b double, c double, y int, split string")


def test_selection(spark):
    x, y, split = made()
    found = logistic.select(frame(spark, x, y, split), ["a", "b", "c"], "y", "split", PENALTIES)
    train, valid, test = (split == s for s in ("train", "validation", "test"))
    expected = {}
    for penalty, one, m in found.candidates:
        model = newton(x[train], y[train], penalty)
        assert one.converged and np.allclose(one.beta, model[2], atol=1e-8)
        brier, log_loss, correct = scores(x[valid], y[valid], model)
        assert (m.n, m.decisive, m.correct) == (valid.sum(), valid.sum(), correct)
        assert abs(float(m.mean_brier) - brier) < 1e-9 and abs(float(m.mean_log_loss) - log_loss) < 1e-9 and -m.mean_brier.as_tuple().exponent == 12
        expected[penalty] = brier
    assert found.penalty == min(expected, key=expected.get)
    both = newton(x[train | valid], y[train | valid], found.penalty)
    assert np.allclose(found.final.beta, both[2], atol=1e-8)
    brier, log_loss, correct = scores(x[test], y[test], both)
    assert abs(float(found.test.mean_brier) - brier) < 1e-9 and found.test.correct == correct and found.test.n == test.sum()


def test_equal_scores_take_the_larger_penalty(spark):
    x, y, split = made()
    x[:] = 1.0  # nothing to learn from: every penalty gives the same model
    assert logistic.select(frame(spark, x, y, split), ["a", "b", "c"], "y", "split", PENALTIES).penalty == 1.0


def test_one_outcome_is_refused(spark):
    x, y, split = made()
    y[split == "train"] = 1
    with pytest.raises(ValueError):
        logistic.select(frame(spark, x, y, split), ["a", "b", "c"], "y", "split", PENALTIES)


def test_one_penalty_equals_fit(spark):
    x, y, split = made(5, 200)
    df = logistic.complete(frame(spark, x, y, split).filter("split = 'train'"), ["a", "b", "c"], "y")
    (one,) = logistic.fit_all(df, ["a", "b", "c"], "y", [0.01])
    assert np.allclose(one.beta, logistic.fit(df, ["a", "b", "c"], "y", 0.01).beta, atol=1e-9)
