"""Prediction grid and predictions with standard errors (survey IDs M8, M9,
A21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.models.design import build_design


def prediction_grid(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """``seq(min(x), max(x), length.out = n)`` as a distinct DataFrame.
    One aggregate for the range (two numbers), the grid from ``range``."""
    r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi = float(r["lo"]), float(r["hi"])
    step = (hi - lo) / (n - 1) if n > 1 else 0.0
    g = df.sparkSession.range(n).select(
        F.when(F.col("id") == n - 1, F.lit(hi)).otherwise(F.lit(lo) + F.col("id") * F.lit(step)).alias(column))
    return g.distinct()


def predict_se(fit, newdata: DataFrame, terms: Sequence[str] | None = None, fit_col: str = "fit",
               se_col: str = "se_fit", link_scale: bool = False) -> DataFrame:
    """Mean on the response scale and its standard error (delta method):
    eta = x'b, fit = exp(eta), se = exp(eta) * sqrt(x' V x). Pure Column
    arithmetic (p is small), so it runs as a projection on any size of
    ``newdata``. ``fit`` is a ``GlmFit`` (its design carries factor levels)."""
    d = fit.design
    if terms is not None or d is None:
        d = build_design(newdata, terms, levels=getattr(d, "levels", None))
    b, V = fit.coef, fit.cov
    xs = d.exprs
    eta = F.lit(0.0)
    for bj, x in zip(b, xs):
        eta = eta + F.lit(float(bj)) * x
    quad = F.lit(0.0)
    for j in range(len(xs)):
        for k in range(len(xs)):
            if V[j, k] != 0:
                quad = quad + F.lit(float(V[j, k])) * xs[j] * xs[k]
    se_eta = F.sqrt(F.greatest(quad, F.lit(0.0)))
    if link_scale:
        return newdata.withColumns({fit_col: eta, se_col: se_eta})
    return newdata.withColumns({fit_col: F.exp(eta), se_col: F.exp(eta) * se_eta})


def average_predictions(pred: DataFrame, keys: Sequence[str], fit_col: str = "fit",
                        se_col: str = "se_fit") -> DataFrame:
    """Mean fitted value and mean se per grid point."""
    return pred.groupBy(*keys).agg(F.avg(fit_col).alias("number"), F.avg(se_col).alias("se_fit"))
