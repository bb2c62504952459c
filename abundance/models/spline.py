"""Smooth terms as natural cubic splines, penalised or not (survey ID M6).

``s(x, k=3, bs="cr")`` places knots evenly through the sorted unique
values of x (k = 3: min, median of the unique values, max). The fitted
curve of an unpenalised cubic regression spline spans the natural cubic
splines on those knots, so the basis here is the truncated-power form of
that space: x plus k - 2 columns, each a Column expression.

``spline_glm`` fits them as an ordinary GLM. ``penalised_spline_glm`` adds
lambda times the integral of the squared second derivative per smooth, the
cubic regression spline's penalty, and chooses each lambda by generalised
cross-validation, by REML, or takes it as given. Every pass sums X'WX, X'Wz
and z'Wz once; the search over lambda works on those p x p sums on the driver
(performance iteration), so it costs no pass of its own.
``tweedie_spline_glm`` searches the variance power around it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundance.models.glm import ETA_MAX, LF, Y, GlmFit, _family_parts, _start_eta, _variance, irls, model_frame
from abundance.models.design import Design, INTERCEPT


def place_knots(df: DataFrame, column: str, k: int = 3) -> list[float]:
    """Knots evenly through the unique values (interpolated): positions
    (i / (k-1)) of the sorted unique values."""
    return place_knots_many(df, [column], k)[column]


def place_knots_many(df: DataFrame, columns: Sequence[str], k: int = 3) -> dict[str, list[float]]:
    """Knots for several columns from the distributed ranks of their distinct
    values, all in one job."""
    from abundance.operators.agg import quantiles
    return quantiles(df, columns, [i / (k - 1) for i in range(k)], distinct=True)


def natural_spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Columns spanning natural cubic splines with the given knots (without
    the constant): x, then d_j - d_{K-1} for j = 1..K-2, where
    d_j = ((x - t_j)_+^3 - (x - t_K)_+^3) / (t_K - t_j)."""
    t = list(knots)
    K = len(t)
    ramp = lambda c: F.greatest(c, F.lit(0.0))
    cube = lambda c: ramp(c) * ramp(c) * ramp(c)

    def d(j):
        return (cube(x - F.lit(t[j])) - cube(x - F.lit(t[-1]))) / F.lit(t[-1] - t[j])

    cols = [x]
    for j in range(K - 2):
        cols.append(d(j) - d(K - 2))
    return cols


def smooth_design(df: DataFrame, smooth: Sequence[str], linear: Sequence[str] = (), k: int = 3,
                  knots: dict | None = None) -> Design:
    knots = dict(knots or {})
    names, exprs, used = [INTERCEPT], [F.lit(1.0)], []
    for c in smooth:
        kn = knots.get(c) or place_knots(df, c, k)
        knots[c] = kn
        for i, e in enumerate(natural_spline_basis(F.col(c).cast("double"), kn)):
            names.append(f"s({c}).{i + 1}")
            exprs.append(e)
        used.append(c)
    for c in linear:
        names.append(c)
        exprs.append(F.col(c).cast("double"))
        used.append(c)
    d = Design(names, exprs, used)
    d.levels = {"__knots__": knots}
    return d


def spline_glm(df: DataFrame, response: str, smooth: Sequence[str], linear: Sequence[str] = (),
               k: int = 3, family: str = "poisson", checkpoint: bool = False) -> GlmFit:
    """``gam(y ~ s(x, k=3, bs="cr"))`` re-aimed: unpenalised natural spline
    basis + IRLS GLM on Spark."""
    from abundance.models.design import model_input
    base = model_input(df, [response, *smooth, *linear], checkpoint)
    try:
        d = smooth_design(base.dropna(), smooth, linear, k)
        frame, feats = model_frame(base, response, [d])
        # Families without canonical link converge linearly: a tight rule settles the last digits.
        fit = irls(frame, feats, [d.names], family, max_iter=60, tol=1e-13)[0]
    finally:
        base.unpersist()
    fit.design = d
    return fit


def spline_penalty(knots: Sequence[float]) -> np.ndarray:
    """Integral of products of the basis columns' second derivatives over the
    knots' range (piecewise linear, so Simpson's rule is exact per interval)."""
    t = np.asarray(knots, float)

    def second(x):
        ramp = lambda j: 6.0 * (np.maximum(x - t[j], 0.0) - np.maximum(x - t[-1], 0.0)) / (t[-1] - t[j])
        return np.stack([np.zeros_like(x)] + [ramp(j) - ramp(len(t) - 2) for j in range(len(t) - 2)])

    out = np.zeros((len(t) - 1, len(t) - 1))
    for a, b in zip(t[:-1], t[1:]):
        v = second(np.array([a, (a + b) / 2, b]))
        out += (v * (np.array([1.0, 4.0, 1.0]) * (b - a) / 6)) @ v.T
    return out


def _working_sums(frame: DataFrame, feats: list[str], beta, family: str):
    """X'WX, X'Wz, z'Wz, deviance, log-likelihood, n and the Pearson sum."""
    y, xs = F.col(Y), [F.col(f) for f in feats]
    eta = F.lit(0.0)
    for b, x in zip(beta if beta is not None else (), xs):
        eta = eta + F.lit(float(b)) * x
    eta = _start_eta(family, y) if beta is None else F.least(F.greatest(eta, F.lit(-ETA_MAX)), F.lit(ETA_MAX))
    data = frame.withColumn("__eta", eta)
    e = F.col("__eta")
    w, wz, dev, ll = _family_parts(family, e, y)
    mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-e)) if family == "binomial" else F.exp(e)
    pear = (y - mu) * (y - mu) / F.greatest(_variance(family, mu), F.lit(1e-300))
    data = data.withColumns({"__w": w, "__wz": wz, "__d": dev, "__l": ll, "__p": pear})
    p = len(xs)
    terms = [F.sum(F.col("__w") * xs[j] * xs[k]) for j in range(p) for k in range(j, p)] + [F.sum(F.col("__wz") * x) for x in xs]
    terms += [F.sum(F.col("__wz") * F.col("__wz") / F.col("__w")), F.sum("__d"), F.sum("__l"), F.count(F.lit(1)), F.sum("__p")]
    v = np.array(data.agg(F.array(*[t.cast("double") for t in terms]).alias("v")).first()["v"], float)
    i, j = np.triu_indices(p)
    a = np.zeros((p, p))
    a[i, j] = a[j, i] = v[:len(i)]
    return a, v[len(i):len(i) + p], *v[len(i) + p:]


def _criterion(method: str, log_lam, A, r, zz, n, penalties, ranks, known_scale: bool) -> float:
    """GCV (UBRE where the dispersion is one) or restricted likelihood (its
    negative) of the working linear model at log lambdas."""
    S = sum(np.exp(x) * P for x, P in zip(log_lam, penalties))
    try:
        b = np.linalg.solve(A + S, r)
        edf = float(np.trace(np.linalg.solve(A + S, A)))
    except np.linalg.LinAlgError:
        return np.inf
    rss = float(zz - 2 * b @ r + b @ A @ b)
    if method == "gcv":
        return rss / n + 2 * edf / n - 1 if known_scale else n * rss / max(n - edf, 1e-9) ** 2
    fit = rss + float(b @ S @ b)
    free = n - (len(r) - sum(ranks))
    det = np.linalg.slogdet(A + S)[1] - sum(k * x for k, x in zip(ranks, log_lam))
    return 0.5 * (fit + det) if known_scale else 0.5 * (free * np.log(max(fit, 1e-300) / free) + det)


def _choose(method, A, r, zz, n, penalties, ranks, known_scale, start) -> np.ndarray:
    """Best log lambdas: a coarse grid per smooth in turn, then golden-section
    refinements, cycled until they stand still."""
    scale = [np.log(max(np.trace(A), 1e-300) / max(np.trace(P), 1e-300)) for P in penalties]
    at = np.array([s if x is None else x for s, x in zip(scale, start)], float)
    value = lambda x: _criterion(method, x, A, r, zz, n, penalties, ranks, known_scale)
    for _ in range(8):
        old = at.copy()
        for m in range(len(at)):
            def one(x):
                return value(np.concatenate((at[:m], [x], at[m + 1:])))

            grid = scale[m] + np.arange(-24.0, 24.5, 1.0)
            best = grid[int(np.argmin([one(x) for x in grid]))]
            lo, hi, g = best - 1.0, best + 1.0, (np.sqrt(5) - 1) / 2
            c, d = hi - g * (hi - lo), lo + g * (hi - lo)
            fc, fd = one(c), one(d)
            while hi - lo > 1e-7:
                if fc <= fd:
                    hi, d, fd = d, c, fc
                    c = hi - g * (hi - lo)
                    fc = one(c)
                else:
                    lo, c, fc = c, d, fd
                    d = lo + g * (hi - lo)
                    fd = one(d)
            at[m] = (lo + hi) / 2
        if np.max(np.abs(at - old)) < 1e-6:
            break
    return at


def penalised_spline_glm(df: DataFrame, response: str, smooth: Sequence[str], linear: Sequence[str] = (), k: int = 3,
                         family: str = "poisson", lam: str | float | Sequence[float] = "gcv", knots: dict | None = None,
                         max_iter: int = 60, tol: float = 1e-10, checkpoint: bool = False) -> GlmFit:
    """``gam(y ~ s(x, k, bs="cr") + ...)``: penalised natural splines, lambda
    per smooth chosen by ``"gcv"`` (UBRE for Poisson and binomial), ``"reml"``
    or given (a number, or one per smooth). 0 is the unpenalised fit; a very
    large one a straight line.

    ``extra``: ``lambda`` and ``edf`` per smooth, ``edf_total`` (the trace of
    the influence matrix, counted by AIC), ``dispersion``. ``cov`` is the
    Bayesian covariance (X'WX + S)^-1 times the dispersion.
    """
    from abundance.models.design import model_input
    base = model_input(df, [response, *smooth, *linear], checkpoint)
    try:
        d = smooth_design(base.dropna(), smooth, linear, k, knots)
        frame, feats = model_frame(base, response, [d])
        frame, p, known_scale = frame.cache(), d.p, not family.startswith("tweedie:")
        penalties, ranks, where, at = [], [], [], 1
        for c in smooth:
            P = spline_penalty(d.levels["__knots__"][c])
            wide = np.zeros((p, p))
            here = slice(at, at + len(P))
            wide[here, here] = P
            at += len(P)
            penalties.append(wide)
            ranks.append(len(P) - 1)
            where.append(here)
        chosen = None if isinstance(lam, str) else np.broadcast_to(np.asarray(lam, float), (len(smooth),))
        logs, beta, last, converged, it = [None] * len(smooth), None, None, False, 0
        for it in range(max_iter):
            A, r, zz, dev, ll, n, pear = _working_sums(frame, feats[0], beta, family)
            if chosen is None:
                old, logs = logs, list(_choose(lam, A, r, zz, n, penalties, ranks, known_scale, logs))
                lams = np.exp(np.array(logs))
                # Settled (or circling): the last passes are for the coefficients alone.
                if it >= 12 or None not in old and np.max(np.abs(np.array(logs) - np.array(old))) < 1e-3:
                    chosen, last = lams, None
            else:
                lams = chosen
            S = sum(x * P for x, P in zip(lams, penalties))
            objective = dev + (0.0 if beta is None else float(beta @ S @ beta))
            if last is not None and abs(objective - last) / (abs(objective) + 0.1) < tol:
                converged = True
                break
            last, beta = objective, np.linalg.solve(A + S, r)
        frame.unpersist()
    finally:
        base.unpersist()
    inverse = np.linalg.inv(A + S)
    influence = np.diag(inverse @ A)
    edf = float(influence.sum())
    phi = 1.0 if known_scale else pear / (n - edf)
    fit = GlmFit(d.names, beta, inverse * phi, dev, ll, int(n), it, converged, family)
    fit.design = d
    fit.extra.update(dispersion=phi, edf_total=edf, n_params=edf + (0 if known_scale else 1))
    fit.extra["lambda"] = {c: float(x) for c, x in zip(smooth, lams)}
    fit.extra["edf"] = {c: float(influence[h].sum()) for c, h in zip(smooth, where)}
    return fit


def tweedie_spline_glm(df: DataFrame, response: str, smooth: Sequence[str], linear: Sequence[str] = (), k: int = 3,
                       lam: str | float = "gcv", low: float = 1.05, high: float = 1.95, width: float = 0.01, **kw) -> GlmFit:
    """Penalised splines with the Tweedie variance power estimated: golden
    section over the power for the largest log-likelihood (series density)."""
    from abundance.models.tweedie import tweedie_loglik
    seen: dict = {}

    def fit_at(power):
        power = round(power, 4)
        if power not in seen:
            fit = penalised_spline_glm(df, response, smooth, linear, k, f"tweedie:{power}", lam, **kw)
            fit.loglik = tweedie_loglik(df, response, fit)
            fit.extra["n_params"] = fit.extra["edf_total"] + 2       # dispersion and power
            fit.extra["power"] = power
            seen[power] = fit
        return seen[power]

    g = (np.sqrt(5) - 1) / 2
    while high - low > width:
        c, e = high - g * (high - low), low + g * (high - low)
        if fit_at(c).loglik >= fit_at(e).loglik:
            high = e
        else:
            low = c
    return max(seen.values(), key=lambda f: f.loglik)
