"""Full-subset model selection per response (survey ID M7).

For each response (a label column): every predictor subset up to
``max_size`` whose members are not collinear (|r| > ``cor_cutoff``), plus
the null model, is fitted; AICc, delta, Akaike weights, cumulative weight
and variable importance (sum of weights of the models holding a
predictor) are reported. All candidates and all responses are fitted in
the same IRLS passes (per-task numpy sums by response over a cached frame,
a batch of candidates per pass), so the work is a few dozen scans, not one
job per model. The candidate count is checked against ``max_models``
(an error, never a silent cut).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.models.design import INTERCEPT, Design
from abundance.models.glm import irls, model_frame
from abundance.models.spline import natural_spline_basis, place_knots_many
from abundance.operators.agg import corr_matrix


def candidate_sets(predictors: Sequence[str], max_size: int, forbidden: set[frozenset]) -> list[tuple]:
    out = [()]
    for r in range(1, max_size + 1):
        for combo in combinations(predictors, r):
            if any(frozenset(p) in forbidden for p in combinations(combo, 2)):
                continue
            out.append(combo)
    return out


class Subsets(tuple):
    """The pair (models, importance), with the failed fits beside it."""

    def __new__(cls, models: DataFrame, importance: DataFrame, failed: DataFrame):
        pair = super().__new__(cls, (models, importance))
        pair.models, pair.importance, pair.failed = models, importance, failed
        return pair


def full_subsets(df: DataFrame, value: str, predictors: Sequence[str], response: str = "response",
                 max_size: int = 3, cor_cutoff: float = 0.28, max_models: int = 600, smooth: bool = True,
                 k: int = 3, family: str = "poisson", batch: int = 128,
                 checkpoint: bool = False) -> Subsets:
    """Return (model table, variable importance), both DataFrames; the
    result's ``failed`` is the table of failed models.

    Only converged fits with a finite AICc are ranked and weighted; the
    others are listed as failed (response, modname, loglik, converged).

    Model table: response, modname, n_used, edf, loglik, aicc, bic,
    delta_aicc, wi_aicc, cumsum_wi, converged. Importance: response,
    predictor, importance. ``family`` is ``"poisson"`` or ``"tweedie:<p>"``;
    for Tweedie the log-likelihood of every candidate comes from one more
    Arrow pass (series density, dispersion counted as a parameter).
    """
    spark = df.sparkSession
    preds = list(predictors)
    base = df.select(*dict.fromkeys([value, response, *preds])).dropna()
    if checkpoint:
        from abundance.session import cut_lineage
        base = cut_lineage(base)
    else:
        base = base.cache()
    corr = corr_matrix(base, preds).collect()          # k(k-1)/2 numbers
    forbidden = {frozenset((r["var1"], r["var2"])) for r in corr
                 if r["r"] is not None and abs(r["r"]) > cor_cutoff}
    cands = candidate_sets(preds, max_size, forbidden)
    if len(cands) > max_models:
        raise ValueError(f"{len(cands)} candidate models exceed max_models={max_models}")
    knots = place_knots_many(base, preds, k) if smooth else {}
    basis = {}
    for c in preds:
        x = F.col(c).cast("double")
        cols = natural_spline_basis(x, knots[c]) if smooth else [x]
        basis[c] = [(f"s({c}).{i + 1}" if smooth else c, e) for i, e in enumerate(cols)]
    designs = []
    for combo in cands:
        names, exprs = [INTERCEPT], [F.lit(1.0)]
        for c in combo:
            for n, e in basis[c]:
                names.append(n)
                exprs.append(e)
        designs.append(Design(names, exprs, list(combo)))
    frame, feats = model_frame(base, value, designs, group=response)
    rows = []
    try:
        for s in range(0, len(designs), batch):
            idx = list(range(s, min(s + batch, len(designs))))
            res = irls(frame, [feats[i] for i in idx], [designs[i].names for i in idx], family, grouped=True)
            for (m, g), fit in res.items():
                combo = cands[idx[m]]
                rows.append((g, "+".join(combo) if combo else "null", combo, fit))
        if family.startswith("tweedie:"):
            _tweedie_logliks(frame, rows, family)
    finally:
        base.unpersist()
    out, failed, kept = [], [], []
    for g, name, combo, fit in rows:
        n, kk = fit.n_used, fit.n_params
        if not (fit.converged and np.isfinite(fit.loglik)):
            failed.append((str(g), name, float(fit.loglik), bool(fit.converged)))
            continue
        kept.append((g, name, combo, fit))
        aicc = fit.aic + (2.0 * kk * (kk + 1) / (n - kk - 1) if n - kk - 1 > 0 else float("inf"))
        bic = -2.0 * fit.loglik + kk * float(np.log(n)) if n > 0 else float("nan")
        out.append((str(g), name, int(n), int(kk), float(fit.loglik), float(aicc), float(bic), bool(fit.converged)))
    models = spark.createDataFrame(
        out, "response string, modname string, n_used long, edf int, loglik double, aicc double, bic double, "
             "converged boolean")
    from abundance.plans.pipelines import model_report
    ranked = model_report(models, max_delta=float("inf"))
    # importance = sum of Akaike weights of the models holding each predictor
    imp_rows = []
    by_resp: dict = {}
    for g, name, combo, fit in kept:
        by_resp.setdefault(str(g), []).append((name, combo, fit))
    for g, lst in by_resp.items():
        aiccs = []
        for name, combo, fit in lst:
            n, kk = fit.n_used, fit.n_params
            aiccs.append(fit.aic + (2.0 * kk * (kk + 1) / (n - kk - 1) if n - kk - 1 > 0 else np.inf))
        a = np.array(aiccs)
        w = np.exp(-(a - a.min()) / 2)
        w = w / w.sum()
        for c in preds:
            imp_rows.append((g, c, float(sum(wi for wi, (_, combo, _) in zip(w, lst) if c in combo))))
    importance = spark.createDataFrame(imp_rows, "response string, predictor string, importance double")
    return Subsets(ranked, importance, spark.createDataFrame(
        failed, "response string, modname string, loglik double, converged boolean"))


def _tweedie_logliks(frame: DataFrame, rows: list, family: str) -> None:
    """Tweedie log-likelihood of every (response, candidate) at its fitted
    coefficients and Pearson dispersion; sets ``fit.loglik``.

    With t(y) the saturated part of the deviance, a log density is
    s(y, phi) + t(y) / phi - (unit deviance) / (2 phi), where s is the series.
    The deviance is known from the fit, so what is left depends on the value
    and the dispersion only: it is summed over the distinct values and their
    counts, which Spark aggregates."""
    from abundance.models.glm import Y, tweedie_power
    from abundance.models.tweedie import tweedie_logpdf
    power = tweedie_power(family)
    spec: dict = {}
    for k, (g, _name, _combo, fit) in enumerate(rows):
        spec.setdefault(g, []).append((k, float(fit.extra.get("dispersion", 1.0))))

    def part(batches):
        import pandas as pd
        acc: dict = {}
        for pdf in batches:
            for g, some in pdf.groupby("__g", sort=False):
                y, n = some[Y].to_numpy(float), some["__n"].to_numpy(float)
                for k, phi in spec[g]:
                    # at mu = y the unit deviance is zero, so this is s + t / phi; a zero's is 0
                    full = np.where(y > 0, tweedie_logpdf(y, np.where(y > 0, y, 1.0), phi, power), 0.0)
                    acc[k] = acc.get(k, 0.0) + float(full @ n)
        if acc:
            yield pd.DataFrame({"__k": list(acc.keys()), "__ll": list(acc.values())})

    red = (frame.groupBy("__g", Y).agg(F.count(F.lit(1)).alias("__n")).mapInPandas(part, "__k int, __ll double")
           .groupBy("__k").agg(F.sum("__ll").alias("__ll")).collect())
    for r in red:
        fit = rows[r["__k"]][3]
        fit.loglik = r["__ll"] - fit.deviance / (2.0 * fit.extra.get("dispersion", 1.0))
        fit.extra["n_params"] = fit.p + 1
