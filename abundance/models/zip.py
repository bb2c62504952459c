"""Zero-inflated Poisson regression (survey ID M2).

Count part: log link; zero part: logit link; by default the same
regressors in both (``zeroinfl(y ~ x)``). Start values come from a
Poisson GLM for the counts and a logistic GLM for ``y == 0`` (both IRLS
on Spark); then Newton steps on the full log-likelihood, each one Spark
aggregate of the per-row gradient and Hessian (closed form, evaluated in
a numerically stable form), with step halving when the likelihood drops.
Standard errors from the observed information.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.functions.columns import ln_factorial
from abundance.functions.stats import norm_two_sided_p
from abundance.models.design import build_design, design_columns, model_input
from abundance.models.glm import Y, irls, model_frame


def _softplus(x):
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _sigmoid(x):
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


@dataclass
class ZipFit:
    count_names: list[str]
    zero_names: list[str]
    coef: np.ndarray            # count coefficients then zero coefficients
    cov: np.ndarray
    loglik: float
    n_used: int
    iterations: int
    converged: bool

    @property
    def p(self) -> int:
        return len(self.coef)

    @property
    def aic(self) -> float:
        return -2.0 * self.loglik + 2.0 * self.p

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def table(self) -> list[tuple]:
        rows = []
        names = [f"count_{n}" for n in self.count_names] + [f"zero_{n}" for n in self.zero_names]
        for n, b, s in zip(names, self.coef, self.se):
            z = b / s if s > 0 else float("nan")
            rows.append((n, float(b), float(s), float(z), norm_two_sided_p(z) if s > 0 else float("nan")))
        return rows


def _pass(frame: DataFrame, xf: list[str], zf: list[str], beta, gamma):
    y = F.col(Y)
    X = [F.col(c) for c in xf]
    Z = [F.col(c) for c in zf]
    a = F.lit(0.0)
    for b, x in zip(beta, X):
        a = a + F.lit(float(b)) * x
    bz = F.lit(0.0)
    for g, z in zip(gamma, Z):
        bz = bz + F.lit(float(g)) * z
    mu = F.exp(a)
    pi = _sigmoid(bz)
    tau = _sigmoid(bz + mu)
    r = _sigmoid(-(bz + mu))
    zero = y == 0
    ll = F.when(zero, -mu + _softplus(bz + mu) - _softplus(bz)).otherwise(
        -_softplus(bz) + y * a - mu - ln_factorial(y))
    ga = F.when(zero, -mu * r).otherwise(y - mu)
    gb = F.when(zero, tau - pi).otherwise(-pi)
    haa = F.when(zero, -mu * r + mu * mu * r * tau).otherwise(-mu)
    hbb = F.when(zero, tau * (1 - tau) - pi * (1 - pi)).otherwise(-pi * (1 - pi))
    hab = F.when(zero, mu * r * tau).otherwise(F.lit(0.0))
    terms = [F.sum(ll), F.count(F.lit(1))]
    terms += [F.sum(ga * x) for x in X] + [F.sum(gb * z) for z in Z]
    p, q = len(X), len(Z)
    terms += [F.sum(haa * X[j] * X[k]) for j in range(p) for k in range(j, p)]
    terms += [F.sum(hbb * Z[j] * Z[k]) for j in range(q) for k in range(j, q)]
    terms += [F.sum(hab * X[j] * Z[k]) for j in range(p) for k in range(q)]
    v = np.array(frame.agg(F.array(*[t.cast("double") for t in terms]).alias("s")).first()["s"], dtype=float)
    ll_v, n = v[0], int(v[1])
    i = 2
    g = v[i:i + p + q]
    i += p + q
    H = np.zeros((p + q, p + q))
    for j in range(p):
        for k in range(j, p):
            H[j, k] = H[k, j] = v[i]
            i += 1
    for j in range(q):
        for k in range(j, q):
            H[p + j, p + k] = H[p + k, p + j] = v[i]
            i += 1
    for j in range(p):
        for k in range(q):
            H[j, p + k] = H[p + k, j] = v[i]
            i += 1
    return ll_v, n, g, H


def zip_model(df: DataFrame, response: str, terms: Sequence[str], zero_terms: Sequence[str] | None = None,
              max_iter: int = 50, tol: float = 1e-9, start_iter: int = 4,
              checkpoint: bool = False) -> ZipFit:
    """``zeroinfl(y ~ terms | zero_terms, dist="poisson")``."""
    zt = zero_terms if zero_terms is not None else terms
    base = model_input(df, [response, *design_columns(terms), *design_columns(zt)], checkpoint)
    try:
        dc = build_design(base, terms)
        dz = build_design(base, zt)
        frame, feats = model_frame(base, response, [dc, dz])
        xf, zf = feats
        # start values: Poisson GLM for counts, logistic GLM for zeros
        # (a few IRLS steps suffice: they are only starting values)
        pois = irls(frame, [xf], [dc.names], "poisson", max_iter=start_iter)[0]
        zframe = frame.withColumn(Y, (F.col(Y) == 0).cast("double"))
        logi = irls(zframe, [zf], [dz.names], "binomial", max_iter=start_iter)[0]
        theta = np.concatenate([pois.coef, logi.coef])
        p = len(xf)
        ll, n, g, H = _pass(frame, xf, zf, theta[:p], theta[p:])
        it, converged, step = 0, False, None
        while it < max_iter:
            it += 1
            A = -H
            lam = 0.0
            while True:
                try:
                    np.linalg.cholesky(A + lam * np.eye(len(A)))
                    break
                except np.linalg.LinAlgError:
                    lam = max(2 * lam, 1e-6 * (np.abs(np.diag(A)).max() + 1))
            step = np.linalg.solve(A + lam * np.eye(len(A)), g)
            t = 1.0
            for _ in range(30):
                cand = theta + t * step
                ll2, n2, g2, H2 = _pass(frame, xf, zf, cand[:p], cand[p:])
                if np.isfinite(ll2) and ll2 >= ll - 1e-12 * abs(ll):
                    break
                t /= 2
            else:
                break                       # no step raises the likelihood: stay, not converged
            dll = ll2 - ll
            theta, ll, g, H = cand, ll2, g2, H2
            if abs(dll) < tol * (abs(ll) + 1) and np.max(np.abs(t * step)) < 1e-6:
                converged = True
                break
        try:
            cov = np.linalg.inv(-H)
        except np.linalg.LinAlgError:
            cov = np.linalg.pinv(-H)
        return ZipFit(dc.names, dz.names, theta, cov, float(ll), n, it, converged)
    finally:
        base.unpersist()
