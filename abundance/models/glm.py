"""Poisson and logistic GLMs by IRLS, one Spark aggregate per iteration
(survey IDs M1, M4, M5; one fit per group, M10, is in ``glm_groups``).

Rows -> a cached frame of (y, x_1..x_k) with incomplete rows dropped.
Each IRLS iteration is one ``agg`` (or ``groupBy(group).agg``) computing,
for every model being fitted, X'WX, X'Wz, the deviance and the
log-likelihood; partial aggregation keeps hot groups cheap. The driver
solves the p x p systems. Many candidate models (full-subset search) and
many responses (one fit per response) share the same passes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundance.functions.columns import ln_factorial
from abundance.functions.stats import norm_two_sided_p
from abundance.models.design import INTERCEPT, Design, build_design, design_columns, model_input

Y = "__y"
W = "__pw"
LF = "__lfact"
ETA_MAX = 300.0          # linear predictors are kept where exp() and its square are finite
WIDE = 24                # designs of more columns are summed by numpy, not by p^2 expressions


@dataclass
class GlmFit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    deviance: float
    loglik: float
    n_used: int
    iterations: int
    converged: bool
    family: str = "poisson"
    group: object = None
    design: Design | None = None
    extra: dict = field(default_factory=dict)

    @property
    def p(self) -> int:
        return len(self.names)

    @property
    def df_residual(self) -> int:
        return self.n_used - self.p

    @property
    def df_null(self) -> int:
        return self.n_used - (1 if INTERCEPT in self.names else 0)

    @property
    def null_deviance(self) -> float | None:
        """Deviance of the model with only an intercept on the same rows."""
        return self.extra.get("null_deviance")

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    @property
    def n_params(self) -> float:
        return self.extra.get("n_params", self.p)

    @property
    def aic(self) -> float:
        return -2.0 * self.loglik + 2.0 * self.n_params

    @property
    def aicc(self) -> float:
        n, k = self.n_used, self.n_params
        return self.aic + (2.0 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf)

    def table(self) -> list[tuple]:
        rows = []
        for n, b, s in zip(self.names, self.coef, self.se):
            z = b / s if s > 0 else float("nan")
            rows.append((n, float(b), float(s), float(z), norm_two_sided_p(z) if s > 0 else float("nan")))
        return rows


# --------------------------------------------------------------- framing

def model_frame(df: DataFrame, response: str, designs: Sequence[Design], weight: str | None = None,
                group: str | None = None) -> tuple[DataFrame, list[list[str]]]:
    """Project y, the union of design columns (computed once), optional
    prior weight and group; drop incomplete rows (R na.omit, T19)."""
    cols, index, feats_per = [], {}, []
    for d in designs:
        fs = []
        for n, e in zip(d.names, d.exprs):
            if n not in index:
                index[n] = f"__x{len(index)}"
                cols.append(e.alias(index[n]))
            fs.append(index[n])
        feats_per.append(fs)
    raw = sorted({c for d in designs for c in d.columns} | {response})
    base = df.dropna(subset=raw + ([weight] if weight else []) + ([group] if group else []))
    sel = [F.col(response).cast("double").alias(Y), ln_factorial(F.col(response)).alias(LF), *cols]
    if weight:
        sel.append(F.col(weight).cast("double").alias(W))
    if group:
        sel.append(F.col(group).alias("__g"))
    return base.select(*sel), feats_per


def _family_parts(family: str, eta: Column, y: Column):
    if family == "poisson":
        mu = F.exp(eta)
        w = mu
        wz = mu * eta + (y - mu)
        dev = F.lit(2.0) * (F.when(y > 0, y * (F.log(y) - eta)).otherwise(F.lit(0.0)) - (y - mu))
        ll = y * eta - mu - F.col(LF)
    elif family == "binomial":
        mu = F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))
        w = mu * (F.lit(1.0) - mu)
        wz = w * eta + (y - mu)
        # log-likelihood in a stable form: y*eta - log(1 + e^eta)
        softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        ll = y * eta - softplus
        dev = F.lit(-2.0) * ll
    elif family.startswith("tweedie:"):
        p = tweedie_power(family)
        mu = F.exp(eta)
        w = F.pow(mu, 2.0 - p)
        wz = w * eta + (y - mu) * F.pow(mu, 1.0 - p)
        y_term = F.when(y > 0, F.pow(y, 2.0 - p) / ((1.0 - p) * (2.0 - p))).otherwise(F.lit(0.0))
        dev = F.lit(2.0) * (y_term - y * F.pow(mu, 1.0 - p) / (1.0 - p) + F.pow(mu, 2.0 - p) / (2.0 - p))
        ll = F.lit(float("nan"))                          # no closed-form density (as in Spark ML)
    else:
        raise ValueError(f"family {family!r} not supported")
    return w, wz, dev, ll


def tweedie_power(family: str) -> float:
    """``"tweedie:1.5"`` -> 1.5 (log link, fixed variance power 1 < p < 2)."""
    p = float(family.split(":", 1)[1])
    if not 1.0 < p < 2.0:
        raise ValueError("tweedie variance power must be in (1, 2)")
    return p


def _variance(family: str, mu: Column) -> Column:
    if family == "binomial":
        return mu * (F.lit(1.0) - mu)
    if family.startswith("tweedie:"):
        return F.pow(mu, tweedie_power(family))
    return mu


def _start_eta(family: str, y: Column) -> Column:
    if family != "binomial":
        return F.log(y + F.lit(0.1))
    return F.log((y + 0.5) / (F.lit(1.5) - y))       # mustart = (y + 0.5) / 2


def _sums(frame: DataFrame, feats: list[list[str]], betas: list, family: str, has_w: bool,
          offset_col: str | None = None) -> dict:
    """One pass for narrow designs without groups. betas[m] is None (start)
    or a vector. Returns {None: [(sums...) per model]}.

    Working weights, working responses, deviance and log-likelihood are
    computed in a projection; the aggregate holds only plain sums of
    products, which keeps generated code small."""
    y = F.col(Y)
    data = frame
    proj = {}
    for m, fs in enumerate(feats):
        b = betas[m]
        xs = [F.col(f) for f in fs]
        if b is None:
            eta = _start_eta(family, y)
        else:
            eta = F.lit(0.0)
            for j, x in enumerate(xs):
                eta = eta + F.lit(float(b[j])) * x
        if offset_col:
            eta = eta + F.col(offset_col)
        eta = F.least(F.greatest(eta, F.lit(-ETA_MAX)), F.lit(ETA_MAX))
        w, wz, dev, ll = _family_parts(family, eta, y)
        mu = (F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))) if family == "binomial" else F.exp(eta)
        pear = (y - mu) * (y - mu) / F.greatest(_variance(family, mu), F.lit(1e-300))
        if has_w:
            pw = F.col(W)
            w, wz, dev, ll, pear = w * pw, wz * pw, dev * pw, ll * pw, pear * pw
        proj.update({f"__w{m}": w, f"__wz{m}": wz, f"__d{m}": dev, f"__l{m}": ll, f"__p{m}": pear})
    data = data.withColumns(proj)
    out_cols = []
    for m, fs in enumerate(feats):
        xs = [F.col(f) for f in fs]
        w, wz = F.col(f"__w{m}"), F.col(f"__wz{m}")
        p = len(xs)
        terms = [F.sum(w * xs[j] * xs[k]) for j in range(p) for k in range(j, p)]
        terms += [F.sum(wz * x) for x in xs]
        terms += [F.sum(f"__d{m}"), F.sum(f"__l{m}"), F.count(F.lit(1)), F.sum(f"__p{m}")]
        out_cols.append(F.array(*[t.cast("double") for t in terms]).alias(f"__m{m}"))
    r = data.agg(*out_cols).first()
    return {None: [r[f"__m{m}"] for m in range(len(feats))]}


def family_arrays(family: str, eta: np.ndarray, y: np.ndarray, lf: np.ndarray):
    """``_family_parts`` and the Pearson terms for arrays of one shape:
    (w, wz, deviance, log-likelihood, Pearson); no more than two exponentials a value."""
    if family == "poisson":
        w = mu = var = np.exp(eta)
        wz = mu * eta + (y - mu)
        ylog = np.where(y > 0, y * (np.log(np.where(y > 0, y, 1.0)) - eta), 0.0)
        dev = 2.0 * (ylog - (y - mu))
        ll = y * eta - mu - lf
    elif family == "binomial":
        mu = 1.0 / (1.0 + np.exp(-eta))
        w = var = mu * (1.0 - mu)
        wz = w * eta + (y - mu)
        ll = y * eta - (np.maximum(eta, 0) + np.log1p(np.exp(-np.abs(eta))))
        dev = -2.0 * ll
    else:
        tp = tweedie_power(family)
        mu, low = np.exp(eta), np.exp((1.0 - tp) * eta)             # mu^(1 - p)
        w = mu * low
        wz = w * eta + (y - mu) * low
        yt = np.where(y > 0, np.where(y > 0, y, 1.0) ** (2.0 - tp) / ((1 - tp) * (2 - tp)), 0.0)
        dev = 2.0 * (yt - y * low / (1.0 - tp) + w / (2.0 - tp))
        ll = np.full_like(eta, np.nan)
        var = mu / low
    pear = (y - mu) ** 2 / np.maximum(var, 1e-300)
    return w, wz, dev, ll, pear


def _sums_arrow(frame: DataFrame, feats: list[list[str]], betas: list, family: str, has_w: bool,
                grouped: bool) -> dict:
    """One pass for a batch of models: every task turns its Arrow batches
    into numpy arrays and adds X'WX, X'Wz, deviance and log-likelihood for
    every (group, model); Spark then sums the per-task vectors by
    (group, model, position). Used for groups, for wide designs and when many
    models share a pass, where one JVM aggregate with hundreds of expressions
    costs more to plan and compile than to run. Batches are split into groups
    by one sort. The models' linear predictors and their sums are one matrix
    product each over blocks of rows that stay in a core's cache: a product of
    two columns is taken once for all models that hold both."""
    all_feats = sorted({f for fs in feats for f in fs})
    pos = {f: i for i, f in enumerate(all_feats)}
    idx = [[pos[f] for f in fs] for fs in feats]
    cols = [Y, LF, *all_feats] + ([W] if has_w else []) + (["__g"] if grouped else [])
    gtype = dict(frame.dtypes)["__g"] if grouped else "string"
    bet = [b if b is None or isinstance(b, dict) else np.asarray(b, float) for b in betas]
    M, k = len(idx), len(all_feats)
    wide = max(len(ix) for ix in idx) > WIDE
    pairs = [] if wide else sorted({(min(a, b), max(a, b)) for ix in idx for a in ix for b in ix})
    pair_at = {ab: i for i, ab in enumerate(pairs)}
    own = [np.array([pair_at[min(ix[i], ix[j]), max(ix[i], ix[j])] for i in range(len(ix)) for j in range(i, len(ix))], int)
           for ix in idx] if not wide else []
    first, second = (np.array([ab[i] for ab in pairs], int) for i in (0, 1))
    holds = np.zeros((k, M))
    for m, ix in enumerate(idx):
        holds[ix, m] = 1.0

    def coefficients(g):
        out, started = np.zeros((k, M)), np.zeros(M, bool)
        for m, ix in enumerate(idx):
            b = np.asarray(bet[m][g], float) if isinstance(bet[m], dict) else bet[m]
            if b is not None:
                out[ix, m], started[m] = b, True
        return out, started

    def block_sums(y, lf, X, pw, coef, started):
        """One block's vectors, a list by model."""
        gap = np.isnan(X)
        there = None
        if gap.any():                           # rows that lack a column of a model are not its rows
            there = gap.astype(float) @ holds == 0
            X = np.where(gap, 0.0, X)
        y, lf = y[:, None], lf[:, None]
        if started.any():
            eta = np.clip(X @ coef, -ETA_MAX, ETA_MAX)
        else:
            eta = np.empty((len(X), M))
        if not started.all():
            eta[:, ~started] = np.log(y + 0.1) if family != "binomial" else np.log((y + 0.5) / (1.5 - y))
        parts = family_arrays(family, eta, y, lf)
        if pw is not None:
            parts = [x * pw[:, None] for x in parts]
        if there is not None:
            parts = [np.where(there, x, 0.0) for x in parts]
        w, wz, *rest = parts
        n = np.full(M, float(len(X))) if there is None else there.sum(0).astype(float)
        z = wz.T @ X
        tail = np.stack([rest[0].sum(0), rest[1].sum(0), n, rest[2].sum(0)], 1)
        if wide:
            tri = [((X[:, ix] * w[:, m:m + 1]).T @ X[:, ix])[np.triu_indices(len(ix))] for m, ix in enumerate(idx)]
        else:
            products = w.T @ (X[:, first] * X[:, second])
            tri = [products[m, o] for m, o in enumerate(own)]
        return [np.concatenate((tri[m], z[m, ix], tail[m])) for m, ix in enumerate(idx)]

    def part(batches):
        import pandas as pd
        acc: dict = {}
        size = max(256, 65_536 // max(M, k, len(pairs)))
        for pdf in batches:
            y_all = pdf[Y].to_numpy(float)
            lf_all = pdf[LF].to_numpy(float)
            X_all = pdf[all_feats].to_numpy(float)
            pw_all = pdf[W].to_numpy(float) if has_w else None
            pieces = pdf.groupby("__g", sort=False).indices.items() if grouped else [(None, np.arange(len(pdf)))]
            for g, rows in pieces:
                coef, started = coefficients(g)
                for i in range(0, len(rows), size):
                    r = rows[i:i + size]
                    vectors = block_sums(y_all[r], lf_all[r], X_all[r], pw_all[r] if has_w else None, coef, started)
                    acc[g] = [a + v for a, v in zip(acc[g], vectors)] if g in acc else vectors
        if acc:
            yield pd.DataFrame({"__g": [g for g in acc for _ in idx], "__m": list(range(M)) * len(acc),
                                "__v": [v.tolist() for vs in acc.values() for v in vs]})

    out = frame.select(*cols).mapInPandas(part, f"__g {gtype}, __m int, __v array<double>")
    red = (out.select("__g", "__m", F.posexplode("__v").alias("__i", "__x"))
           .groupBy("__g", "__m", "__i").agg(F.sum("__x").alias("__s")).collect())
    res: dict = {}
    for r in red:
        res.setdefault(r["__g"] if grouped else None, {}).setdefault(r["__m"], {})[r["__i"]] = r["__s"]
    return {g: [[d[m][i] for i in range(len(d[m]))] for m in range(len(feats))] for g, d in res.items()}


def _unpack(arr, p):
    a = np.array(arr, dtype=float)
    xtwx = np.zeros((p, p))
    i = 0
    for j in range(p):
        for k in range(j, p):
            xtwx[j, k] = xtwx[k, j] = a[i]
            i += 1
    xtwz = a[i:i + p]
    dev, ll, n, pear = a[i + p], a[i + p + 1], a[i + p + 2], a[i + p + 3]
    return xtwx, xtwz, dev, ll, int(n), pear


def _solve(a, b):
    try:
        return np.linalg.solve(a, b), np.linalg.inv(a)
    except np.linalg.LinAlgError:
        pinv = np.linalg.pinv(a)
        return pinv @ b, pinv


def irls(frame: DataFrame, feats: list[list[str]], names: list[list[str]], family: str = "poisson",
         has_w: bool = False, grouped: bool = False, max_iter: int = 25, tol: float = 1e-8,
         offset_col: str | None = None) -> list[GlmFit] | dict:
    """Fit every model in ``feats`` (each a list of feature columns) at once.

    Convergence per model (and group) uses R's ``glm.fit`` rule:
    |dev - dev_old| / (|dev| + 0.1) < tol. Converged models leave the pass.
    A step whose deviance rises or is not finite is halved, up to 12 times;
    a model that finds no better step ends as not converged.
    """
    M = len(feats)
    keys = None
    state: dict = {}     # (m, g) -> dict(beta, dev, done, it)
    betas: list = [None] * M
    active = list(range(M))
    it = 0
    results: dict = {}
    while active and it <= max_iter:
        sub_feats = [feats[m] for m in active]
        sub_betas = [betas[m] for m in active]
        if grouped or offset_col is None and (len(sub_feats) > 1 or len(sub_feats[0]) > WIDE):
            sums = _sums_arrow(frame, sub_feats, sub_betas, family, has_w, grouped)
        else:
            sums = _sums(frame, sub_feats, sub_betas, family, has_w, offset_col)
        if keys is None:
            keys = list(sums.keys())
        for pos, m in enumerate(active):
            for g in keys:
                st = state.setdefault((m, g), {"dev": None, "done": False, "it": 0})
                if st["done"]:
                    continue
                p = len(feats[m])
                xtwx, xtwz, dev, ll, n, pear = _unpack(sums[g][pos], p)
                worse = st["dev"] is not None and not dev <= st["dev"] + 1e-6 * (abs(st["dev"]) + 0.1)
                if worse and it < max_iter and st.get("last") is not None and st["halved"] < 12:
                    st.update(beta=(st["beta"] + st["last"]) / 2, halved=st["halved"] + 1)
                    continue
                if not np.isfinite(dev):
                    st.update(done=True, xtwx=np.nan_to_num(xtwx, nan=0.0, posinf=0.0, neginf=0.0), dev_final=dev, ll=ll, n=n, pear=pear, failed=True)
                    continue
                if st["dev"] is not None and abs(dev - st["dev"]) / (abs(dev) + 0.1) < tol:
                    st.update(done=True, xtwx=xtwx, dev_final=dev, ll=ll, n=n, pear=pear)
                    continue
                if it == max_iter:
                    st.update(done=True, xtwx=xtwx, dev_final=dev, ll=ll, n=n, pear=pear, failed=True)
                    continue
                beta, _ = _solve(xtwx, xtwz)
                st.update(dev=dev, last=st.get("beta"), beta=beta, it=it + 1, halved=0)
            zero = np.zeros(len(feats[m]))
            if grouped:
                betas[m] = {g: state[(m, g)].get("beta", zero) for g in keys}
            else:
                betas[m] = state[(m, None)].get("beta", zero)
        active = [m for m in active if not all(state[(m, g)]["done"] for g in keys)]
        it += 1
    for m in range(M):
        for g in keys:
            st = state[(m, g)]
            beta = st.get("beta", np.zeros(len(feats[m])))
            try:
                cov = np.linalg.inv(st["xtwx"])
            except np.linalg.LinAlgError:
                cov = np.linalg.pinv(st["xtwx"])
            phi = 1.0
            if family.startswith("tweedie:") and st["n"] > len(feats[m]):
                phi = st["pear"] / (st["n"] - len(feats[m]))       # Pearson dispersion estimate
            fit = GlmFit(names[m], beta, cov * phi, st["dev_final"], st["ll"], st["n"], st["it"],
                         not st.get("failed", False), family, g)
            fit.extra["dispersion"] = phi
            results[(m, g)] = fit
    if grouped:
        return results
    return [results[(m, None)] for m in range(M)]


def null_deviance(frame: DataFrame, family: str, has_w: bool) -> float | None:
    """Deviance at the (weighted) mean response, from one aggregate; None for
    families other than Poisson and binomial."""
    y, w = F.col(Y), F.col(W) if has_w else F.lit(1.0)
    ylogy = F.when(y > 0, y * F.log(F.when(y > 0, y))).otherwise(F.lit(0.0))
    r = frame.agg(F.sum(w).alias("n"), F.sum(w * y).alias("s"), F.sum(w * ylogy).alias("t")).first()
    if not r["n"] or family not in ("poisson", "binomial"):
        return None
    m = r["s"] / r["n"]
    log = lambda v: math.log(v) if v > 0 else 0.0
    if family == "poisson":
        return 2.0 * (r["t"] - r["s"] * log(m))
    return -2.0 * (r["s"] * log(m) + (r["n"] - r["s"]) * log(1 - m))


# ----------------------------------------------------------- public API

def glm(df: DataFrame, response: str, terms: Sequence[str], family: str = "poisson",
        weight: str | None = None, intercept: bool = True, max_iter: int = 25,
        tol: float = 1e-8, cache: bool = True, checkpoint: bool = False) -> GlmFit:
    """``glm(y ~ terms, family=poisson|binomial)``: coefficients, se, z, p,
    deviance, log-likelihood, AIC, n used. Rows with NULL in any model
    variable drop (T19)."""
    base = model_input(df, [response, *design_columns(terms), weight], checkpoint) if cache else df
    try:
        d = build_design(base, terms, intercept)
        frame, feats = model_frame(base, response, [d], weight)
        fit = irls(frame, feats, [d.names], family, weight is not None, max_iter=max_iter, tol=tol)[0]
        fit.extra["null_deviance"] = null_deviance(frame, family, weight is not None) if intercept else None
    finally:
        if cache:
            base.unpersist()
    fit.design = d
    return fit


def glm_set(df: DataFrame, response: str, specs: dict[str, Sequence[str]], family: str = "poisson", max_iter: int = 25,
            tol: float = 1e-8, checkpoint: bool = False) -> dict[str, GlmFit]:
    """Several models of one response (``{name: terms}``), all fitted in the
    same passes over one kept frame. Each model uses the rows that are complete
    in its own columns, as if fitted alone."""
    columns = list(dict.fromkeys(c for terms in specs.values() for c in design_columns(terms)))
    base = model_input(df, [response, *columns], checkpoint)
    try:
        levels: dict = {}
        designs = {}
        for name, terms in specs.items():
            designs[name] = build_design(base, terms, levels=levels)
            levels.update(designs[name].levels)
        index, cols, feats = {}, [], []
        for d in designs.values():
            feats.append([])
            for n, e in zip(d.names, d.exprs):
                key = n, () if n == INTERCEPT else tuple(sorted(d.columns))
                if key not in index:
                    index[key] = f"__x{len(index)}"
                    missing = F.lit(False)
                    for c in key[1]:
                        missing = missing | F.col(c).isNull()
                    cols.append(F.when(~missing, e).alias(index[key]))
                feats[-1].append(index[key])
        frame = base.dropna(subset=[response]).select(F.col(response).cast("double").alias(Y), ln_factorial(F.col(response)).alias(LF), *cols)
        fits = irls(frame, feats, [d.names for d in designs.values()], family, max_iter=max_iter, tol=tol)
    finally:
        base.unpersist()
    for fit, d in zip(fits, designs.values()):
        fit.design = d
    return dict(zip(designs, fits))


def coef_table(spark, fits: dict[str, GlmFit] | GlmFit, digits: int | None = None) -> DataFrame:
    """Coefficient table(s) as a DataFrame: model, term, estimate, se, z, p."""
    if isinstance(fits, GlmFit):
        fits = {"model": fits}
    rows = []
    for name, f in fits.items():
        for t, b, s, z, p in f.table():
            vals = (b, s, z, p) if digits is None else tuple(round(v, digits) for v in (b, s, z, p))
            rows.append((str(name), t, *vals))
    return spark.createDataFrame(rows, "model string, term string, estimate double, se double, z double, p double")


def aic_table(spark, fits: dict[str, GlmFit]) -> DataFrame:
    """M5: ``AIC(m1, m2, ...)`` with parameter count, n used, delta and a
    flag when the models were fitted on different numbers of rows."""
    best = min(f.aic for f in fits.values())
    ns = {f.n_used for f in fits.values()}
    rows = [(k, f.p, f.n_used, float(f.loglik), float(f.aic), float(f.aic - best), len(ns) > 1)
            for k, f in fits.items()]
    return spark.createDataFrame(
        rows, "model string, df int, n_used long, loglik double, aic double, delta double, unequal_n boolean")
