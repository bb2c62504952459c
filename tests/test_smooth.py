"""Penalised smooths: limits of the penalty, the choice of lambda and power."""

import numpy as np
import pandas as pd
import pytest

from abundance.models.glm import glm
from abundance.models.spline import penalised_spline_glm, spline_glm, spline_penalty, tweedie_spline_glm


def _curve(seed=1, n=1500):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 4, n)
    return pd.DataFrame({"x": x, "z": rng.normal(size=n), "y": rng.poisson(np.exp(1.0 + np.sin(1.6 * x)))})


def _basis(x, t):
    cube = lambda v: np.maximum(v, 0.0) ** 3
    d = lambda j: (cube(x - t[j]) - cube(x - t[-1])) / (t[-1] - t[j])
    return np.stack([np.ones_like(x), x] + [d(j) - d(len(t) - 2) for j in range(len(t) - 2)], 1)


def _pirls(pdf, t, lam):
    X, y = _basis(pdf.x.to_numpy(), t), pdf.y.to_numpy(float)
    S = np.zeros((X.shape[1],) * 2)
    S[1:, 1:] = lam * spline_penalty(t)
    eta = np.log(y + 0.1)
    for _ in range(80):
        mu = np.exp(eta)
        z = eta + (y - mu) / mu
        A, r = (X.T * mu) @ X, X.T @ (mu * z)
        b = np.linalg.solve(A + S, r)
        eta = X @ b
    edf = np.trace(np.linalg.solve(A + S, A))
    dev = 2 * np.sum(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0) - (y - mu))
    rss = np.sum(mu * (z - eta) ** 2)
    return b, edf, dev, rss / len(y) + 2 * edf / len(y) - 1


def test_penalty_matrix_is_the_integral():
    t = [0.0, 0.7, 2.0, 3.1, 4.0]
    x = np.linspace(t[0], t[-1], 400_001)
    second = np.gradient(np.gradient(_basis(x, t)[:, 1:], x, axis=0), x, axis=0)
    assert np.allclose(spline_penalty(t), (second.T @ second) * (x[1] - x[0]), rtol=2e-3, atol=1e-2)


def test_no_penalty_and_a_large_one(spark):
    df = spark.createDataFrame(_curve())
    free, zero = spline_glm(df, "y", ["x"], k=5), penalised_spline_glm(df, "y", ["x"], k=5, lam=0.0)
    assert np.allclose(free.coef, zero.coef, atol=1e-6) and np.isclose(zero.extra["edf_total"], 5)
    line, straight = glm(df, "y", ["x"]), penalised_spline_glm(df, "y", ["x"], k=5, lam=1e12)
    assert np.isclose(straight.deviance, line.deviance, rtol=1e-6) and np.isclose(straight.extra["edf_total"], 2, atol=1e-4)


@pytest.mark.parametrize("method", ["gcv", "reml"])
def test_chosen_lambda(spark, method):
    pdf = _curve(3)
    fit = penalised_spline_glm(spark.createDataFrame(pdf).repartition(3), "y", ["x"], k=8, lam=method)
    lam, t = fit.extra["lambda"]["x"], fit.design.levels["__knots__"]["x"]
    b, edf, dev, ubre = _pirls(pdf, t, lam)
    assert fit.converged and np.allclose(fit.coef, b, atol=1e-4) and np.isclose(fit.extra["edf_total"], edf, atol=1e-4) and np.isclose(fit.deviance, dev)
    if method == "gcv":                      # no other lambda has a smaller criterion in the working model
        X, y = _basis(pdf.x.to_numpy(), t), pdf.y.to_numpy(float)
        w = np.exp(X @ b)
        z = X @ b + (y - w) / w
        A, r, P = (X.T * w) @ X, X.T @ (w * z), np.zeros((X.shape[1],) * 2)
        P[1:, 1:] = spline_penalty(t)

        def criterion(at):
            c = np.linalg.solve(A + at * P, r)
            return np.sum(w * (z - X @ c) ** 2) / len(y) + 2 * np.trace(np.linalg.solve(A + at * P, A)) / len(y)

        assert all(criterion(lam * f) > criterion(lam) - 1e-7 for f in (0.1, 0.5, 0.8, 1.25, 2.0, 10.0)) and np.isclose(criterion(lam) - 1, ubre, atol=1e-6)
    mu = np.exp(_basis(np.linspace(0.3, 3.7, 50), t) @ fit.coef)
    assert np.max(np.abs(np.log(mu) - 1.0 - np.sin(1.6 * np.linspace(0.3, 3.7, 50)))) < 0.25 and 3 < fit.extra["edf_total"] < 8


def test_two_smooths_of_which_one_is_flat(spark):
    fit = penalised_spline_glm(spark.createDataFrame(_curve(5)), "y", ["x", "z"], k=6)
    assert fit.extra["edf"]["x"] > 3 and fit.extra["edf"]["z"] < 2.5 and abs(sum(fit.extra["edf"].values()) + 1 - fit.extra["edf_total"]) < 1e-8


def test_tweedie_power_is_found(spark):
    rng = np.random.default_rng(9)
    n, p, phi = 3000, 1.6, 1.2
    x = rng.uniform(0, 3, n)
    mu = np.exp(0.8 + 0.5 * np.sin(2 * x))
    k = rng.poisson(mu ** (2 - p) / (phi * (2 - p)))
    y = np.array([rng.gamma(m * (2 - p) / (p - 1)) if m else 0.0 for m in k]) * phi * (p - 1) * mu ** (p - 1)
    fit = tweedie_spline_glm(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "y", ["x"], k=6, width=0.2)
    assert abs(fit.extra["power"] - p) < 0.15 and abs(fit.extra["dispersion"] - phi) < 0.4 and fit.converged
