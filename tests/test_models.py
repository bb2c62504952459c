import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from abundance.functions.columns import ln_factorial
from abundance.functions.stats import t_quantile, norm_two_sided_p
from abundance.models.glm import glm
from abundance.models.glm_groups import glm_by_group
from abundance.models.predict import prediction_grid, predict_se
from abundance.models.spline import natural_spline_basis
from abundance.models.zip import zip_model


def test_ln_factorial(spark):
    df = spark.range(0, 200).selectExpr("cast(id as double) as y")
    got = [r.v for r in df.select(ln_factorial("y").alias("v")).collect()]
    assert max(abs(g - math.lgamma(i + 1)) for i, g in enumerate(got)) < 1e-9


def test_t_quantile_and_norm():
    assert math.isclose(t_quantile(0.975, 10), 2.228138851986, rel_tol=1e-9)
    assert math.isclose(norm_two_sided_p(1.959963984540054), 0.05, rel_tol=1e-9)


def test_glm_sites_closed_form(spark):
    rows = [("A", 1), ("A", 3), ("B", 4), ("B", 6), ("C", 10), ("C", 10)]
    df = spark.createDataFrame(rows, "site string, y long")
    f = glm(df, "y", ["site"])
    assert f.names == ["(Intercept)", "siteB", "siteC"]
    assert np.allclose(f.coef, [math.log(2), math.log(5 / 2), math.log(10 / 2)], atol=1e-8)
    assert np.allclose(f.se, [1 / math.sqrt(4), math.sqrt(1 / 10 + 1 / 4), math.sqrt(1 / 20 + 1 / 4)], atol=1e-6)


def test_glm_missing_rows_dropped(spark):
    df = spark.createDataFrame([(1, 0.5), (2, None), (3, 1.5), (0, 0.1)], "y long, x double")
    assert glm(df, "y", ["x"]).n_used == 3


def test_glm_matches_spark_ml(spark):
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import GeneralizedLinearRegression
    rng = np.random.default_rng(3)
    n = 2000
    x = rng.normal(size=n)
    s = rng.choice(["a", "b", "c"], n)
    y = rng.poisson(np.exp(0.3 + 0.2 * x + (s == "b") * 0.5))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "s": s}))
    f = glm(df, "y", ["x", "s"])
    rf = RFormula(formula="y ~ x + s", stringIndexerOrderType="alphabetDesc").fit(df).transform(df)
    m = GeneralizedLinearRegression(family="poisson", link="log").fit(rf)
    assert math.isclose(f.coef[0], m.intercept, rel_tol=1e-6)
    assert math.isclose(f.aic, m.summary.aic, rel_tol=1e-8)


def test_glm_interaction_names(spark):
    df = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.0, 0.0), (3, 1.5, 2.0), (0, 0.1, 1.0), (4, 2.0, 3.0)],
                               "y long, d double, p double")
    assert glm(df, "y", ["d*p"]).names == ["(Intercept)", "d", "p", "d:p"]


def test_glm_by_group_equals_separate(spark):
    rng = np.random.default_rng(4)
    n = 1500
    g = rng.choice(["u", "v"], n)
    x = rng.normal(size=n)
    y = rng.poisson(np.exp(np.where(g == "u", 0.2 + 0.3 * x, 1.0 - 0.2 * x)))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y}))
    for family in ("poisson", "tweedie:1.5"):
        by = glm_by_group(df, "g", "y", ["x"], family).toPandas().set_index("group")
        for key in ["u", "v"]:
            sep = glm(df.where(df.g == key), "y", ["x"], family)
            assert np.allclose(by.loc[key].estimate, sep.coef, atol=1e-8) and np.allclose(by.loc[key].se, sep.se, atol=1e-8)
            assert by.loc[key].converged.all() and np.allclose(by.loc[key].deviance, sep.deviance)
            assert (by.loc[key].iterations == sep.iterations).all() and (by.loc[key].n_used == sep.n_used).all()


def test_glm_by_group_with_many_groups_and_a_hot_one(spark):
    # x is 0 or 1, so the coefficients are the logarithms of two means
    rng = np.random.default_rng(8)
    groups = 30_000
    g = np.concatenate((np.repeat(np.arange(groups), 6), np.zeros(90_000, int)))
    x = np.concatenate((np.tile([0, 0, 0, 1, 1, 1], groups), rng.integers(0, 2, 90_000)))
    y = 1 + rng.poisson(2.0 + x)
    out = glm_by_group(spark.createDataFrame(pd.DataFrame({"g": g, "x": x.astype(float), "y": y})), "g", "y", ["x"]).toPandas()
    assert len(out) == 2 * groups and out.converged.all()
    mean = pd.DataFrame({"g": g, "x": x, "y": y}).groupby(["g", "x"]).y.mean().unstack()
    est = out.pivot(index="group", columns="term", values="estimate")
    assert np.allclose(est["(Intercept)"], np.log(mean[0]), atol=1e-6) and np.allclose(est["x"], np.log(mean[1] / mean[0]), atol=1e-6)


def test_glm_by_group_odd_groups(spark):
    rows = [("a", 1.0, 2), ("a", 2.0, 3), ("a", 3.0, 9), ("one", 1.0, 4), ("none", None, 1), (None, 1.0, 1), ("zero", 1.0, 0), ("zero", 2.0, 0)]
    df = spark.createDataFrame(rows, "g string, x double, y long")
    out = glm_by_group(df, "g", "y", ["x"]).toPandas()
    assert set(out.group) == {"a", "one", "zero"} and len(out) == 6
    assert np.isclose(out[out.group == "one"].estimate.sum(), np.log(4.0))           # minimum norm: x = 1 shares it
    assert glm_by_group(df.limit(0), "g", "y", ["x"]).count() == 0


def test_zip_recovers_truth(spark):
    rng = np.random.default_rng(7)
    n = 5000
    x = rng.normal(size=n)
    pi = 1 / (1 + np.exp(-(-0.5 + 0.8 * x)))
    y = np.where(rng.random(n) < pi, 0, rng.poisson(np.exp(1.0 + 0.4 * x)))
    f = zip_model(spark.createDataFrame(pd.DataFrame({"y": y, "x": x})), "y", ["x"])
    truth = np.array([1.0, 0.4, -0.5, 0.8])
    assert f.converged and np.all(np.abs(f.coef - truth) < 3 * f.se)


def test_zip_reduces_to_glm_without_zeros(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=3000)
    y = rng.poisson(np.exp(1.5 + 0.2 * x)) + 1      # no zeros at all
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x}))
    f, g = zip_model(df, "y", ["x"]), glm(df, "y", ["x"])
    assert np.allclose(f.coef[:2], g.coef, atol=1e-3)


def test_spline_basis_is_natural(spark):
    kn = [0.0, 1.0, 3.0]
    df = spark.createDataFrame([(v,) for v in [3.0, 4.0, 5.0, 6.0]], "x double")
    b = natural_spline_basis(df.x, kn)
    vals = [r[1] for r in df.select(*[c.alias(f"b{i}") for i, c in enumerate(b)]).collect()]
    d = np.diff(vals)
    assert np.allclose(d, d[0])               # linear beyond the last knot


def test_prediction_grid_and_se(spark):
    df = spark.createDataFrame([(float(i), i % 4) for i in range(40)], "x double, y long")
    g = prediction_grid(df, "x", 20)
    assert g.count() == 20
    f = glm(df, "y", ["x"])
    r = predict_se(f, g).orderBy("x").first()
    eta = f.coef[0]
    assert math.isclose(r.fit, math.exp(eta), rel_tol=1e-9)
    assert math.isclose(r.se_fit, math.exp(eta) * math.sqrt(f.cov[0, 0]), rel_tol=1e-9)


def test_glmm_recovers_sigma_and_reduces_to_glm(spark):
    from abundance.models.glmm import poisson_glmm
    rng = np.random.default_rng(11)
    n, q = 3000, 15
    site = rng.integers(0, q, n)
    u = rng.normal(0, 0.5, q)
    x = rng.normal(size=n)
    y = rng.poisson(np.exp(0.5 + 0.3 * x + u[site]))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "site": [f"s{i:02d}" for i in site]}))
    f = poisson_glmm(df, "y", ["x"], ["site"])
    assert f.converged and abs(f.coef[1] - 0.3) < 3 * f.se[1] and 0.25 < f.sigma["site"] < 0.9
    y0 = rng.poisson(np.exp(0.5 + 0.3 * x))
    df0 = spark.createDataFrame(pd.DataFrame({"y": y0, "x": x, "site": [f"s{i:02d}" for i in site]}))
    f0, g0 = poisson_glmm(df0, "y", ["x"], ["site"]), glm(df0, "y", ["x"])
    if f0.sigma["site"] < 1e-3:
        assert np.allclose(f0.coef, g0.coef, atol=1e-4) and math.isclose(f0.loglik, g0.loglik, rel_tol=1e-6)
    assert f0.loglik >= g0.loglik - 1e-6


def test_glmm_crossed_factors(spark):
    from abundance.models.glmm import poisson_glmm
    rng = np.random.default_rng(12)
    n = 3000
    a, b = rng.integers(0, 8, n), rng.integers(0, 5, n)
    ua, ub = rng.normal(0, 0.4, 8), rng.normal(0, 0.4, 5)
    x = rng.normal(size=n)
    y = rng.poisson(np.exp(0.2 + 0.5 * x + ua[a] + ub[b]))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "a": [f"a{i}" for i in a], "b": [f"b{i}" for i in b]}))
    f = poisson_glmm(df, "y", ["x"], ["a", "b"])
    assert f.converged and abs(f.coef[1] - 0.5) < 3 * f.se[1] and set(f.sigma) == {"a", "b"}


def test_glm_with_reliable_checkpoint(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 1.5), (0, 0.1), (4, 2.0)], "y long, x double")
    a, b = glm(df, "y", ["x"]), glm(df, "y", ["x"], checkpoint=True)
    assert np.allclose(a.coef, b.coef) and spark.conf.get("spark.checkpoint.dir")


def test_tweedie_matches_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression
    rng = np.random.default_rng(21)
    n = 3000
    x = rng.normal(size=n)
    mu = np.exp(0.4 + 0.3 * x)
    # compound Poisson-gamma draws (Tweedie, 1 < p < 2)
    k = rng.poisson(mu)
    y = np.array([rng.gamma(2.0, m / 2.0, size=c).sum() if c else 0.0 for c, m in zip(k, mu)])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x}))
    f = glm(df, "y", ["x"], family="tweedie:1.5")
    va = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    m = GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="y").fit(va)
    assert math.isclose(f.coef[0], m.intercept, rel_tol=1e-6)
    assert math.isclose(f.coef[1], m.coefficients[0], rel_tol=1e-6)
    # standard unit deviance (Spark ML instead floors y at 0.1 inside it, so only beta and se compare)
    muh = np.exp(f.coef[0] + f.coef[1] * x)
    p = 1.5
    dev = 2 * np.sum(np.where(y > 0, np.where(y > 0, y, 1) ** (2 - p) / ((1 - p) * (2 - p)), 0)
                     - y * muh ** (1 - p) / (1 - p) + muh ** (2 - p) / (2 - p))
    assert math.isclose(f.deviance, dev, rel_tol=1e-6)
    assert math.isclose(f.se[1], m.summary.coefficientStandardErrors[0], rel_tol=1e-4)
    assert math.isnan(f.aic)


def test_tweedie_loglik_and_power_profile(spark):
    from abundance.models.tweedie import tweedie_glm, tweedie_logpdf, tweedie_profile
    rng = np.random.default_rng(31)
    n = 4000
    x = rng.normal(size=n)
    mu = np.exp(0.5 + 0.3 * x)
    k = rng.poisson(mu)                      # gamma shape 2 per event -> p = 4/3
    y = np.array([rng.gamma(2.0, m / 2.0, size=c).sum() if c else 0.0 for c, m in zip(k, mu)])
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x}))
    f = tweedie_glm(df, "y", ["x"], 1.4)
    muh = np.exp(f.coef[0] + f.coef[1] * x)
    ref = tweedie_logpdf(y, muh, f.extra["dispersion"], 1.4).sum()
    assert math.isclose(f.loglik, ref, rel_tol=1e-9) and math.isfinite(f.aic)
    assert f.n_params == 3
    best, trace = tweedie_profile(df, "y", ["x"], powers=(1.2, 1.3, 1.4, 1.6))
    assert float(best.family.split(":")[1]) in (1.3, 1.4)


def test_full_subsets_tweedie_ranks(spark):
    from abundance.models.select import full_subsets
    rng = np.random.default_rng(41)
    n = 1500
    a, b = rng.normal(size=n), rng.normal(size=n)
    mu = np.exp(0.3 + 0.5 * a)
    k = rng.poisson(mu)
    y = np.array([rng.gamma(2.0, m / 2.0, size=c).sum() if c else 0.0 for c, m in zip(k, mu)])
    df = spark.createDataFrame(pd.DataFrame({"response": "r", "y": y, "a": a, "b": b}))
    ranked, imp = full_subsets(df, "y", ["a", "b"], max_size=2, cor_cutoff=0.9, smooth=False,
                               family="tweedie:1.4")
    top = ranked.orderBy("aicc").first()
    assert "a" in top.modname.split("+") and top.edf == 3 + (1 if "b" in top.modname else 0)
    assert {r.predictor: r.importance for r in imp.collect()}["a"] > 0.9


def _zip_ll_np(theta, y, X):
    p = X.shape[1]
    eta, zeta = X @ theta[:p], X @ theta[p:]
    mu = np.exp(eta)
    sp = lambda v: np.maximum(v, 0) + np.log1p(np.exp(-np.abs(v)))
    from math import lgamma
    lf = np.array([lgamma(v + 1) for v in y])
    return np.sum(np.where(y == 0, -mu + sp(zeta + mu) - sp(zeta), -sp(zeta) + y * eta - mu - lf))


def test_zip_equals_direct_numpy_mle(spark):
    from abundance.models.glmm import _nelder_mead
    rng = np.random.default_rng(17)
    n = 1500
    x = rng.normal(size=n)
    y = np.where(rng.random(n) < 1 / (1 + np.exp(0.3 - 0.6 * x)), 0, rng.poisson(np.exp(0.8 + 0.3 * x)))
    f = zip_model(spark.createDataFrame(pd.DataFrame({"y": y, "x": x})), "y", ["x"])
    X = np.column_stack([np.ones(n), x])
    best, negll = _nelder_mead(lambda t: -_zip_ll_np(t, y, X), f.coef + 0.05, tol=1e-14, max_iter=4000)
    assert math.isclose(-negll, f.loglik, rel_tol=1e-8)
    assert np.allclose(best, f.coef, atol=2e-4)
    assert -negll <= f.loglik + 1e-6          # nothing beats the Spark fit


def test_glmm_laplace_equals_raw_row_computation(spark):
    from abundance.models.glmm import poisson_glmm
    rng = np.random.default_rng(23)
    n, q = 800, 8
    g = rng.integers(0, q, n)
    x = rng.normal(size=n)
    y = rng.poisson(np.exp(0.2 + 0.4 * x + rng.normal(0, 0.6, q)[g]))
    labels = np.array([f"g{i}" for i in g])
    f = poisson_glmm(spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "g": labels})), "y", ["x"], ["g"])
    s2 = f.sigma["g"] ** 2
    from math import lgamma
    lf = np.array([lgamma(v + 1) for v in y])
    eta0 = f.coef[0] + f.coef[1] * x
    total_laplace, total_quad = 0.0, 0.0
    nodes, weights = np.polynomial.hermite_e.hermegauss(80)      # for N(0, 1)
    for lv in np.unique(labels):
        m = labels == lv
        yy, ee, ll0 = y[m], eta0[m], lf[m]
        u = 0.0
        for _ in range(100):                                      # mode of the penalised group term
            mu = np.exp(ee + u)
            step = (np.sum(yy - mu) - u / s2) / (np.sum(mu) + 1 / s2)
            u += step
            if abs(step) < 1e-12:
                break
        mu = np.exp(ee + u)
        h = np.sum(mu)
        total_laplace += np.sum(yy * (ee + u) - mu - ll0) - u * u / (2 * s2) - 0.5 * np.log(1 + s2 * h)
        # adaptive Gauss-Hermite around the mode
        sd = 1 / np.sqrt(h + 1 / s2)
        us = u + sd * nodes
        vals = np.array([np.sum(yy * (ee + uu) - np.exp(ee + uu) - ll0) for uu in us]) \
            - us ** 2 / (2 * s2) - 0.5 * np.log(2 * np.pi * s2) + nodes ** 2 / 2
        mx = vals.max()
        total_quad += mx + np.log(np.sum(weights * np.exp(vals - mx)) * sd)
    assert math.isclose(f.loglik, total_laplace, rel_tol=1e-8)
    assert abs(total_laplace - total_quad) < 0.05 * q            # Laplace close to the exact integral


def test_glmm_diagonal_path_equals_dense(spark):
    from abundance.models.glmm import poisson_glmm
    rng = np.random.default_rng(29)
    n, q = 2000, 12
    g = rng.integers(0, q, n)
    x = rng.normal(size=n)
    y = rng.poisson(np.exp(0.3 + 0.2 * x + rng.normal(0, 0.5, q)[g]))
    df = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "g": [f"g{i:02d}" for i in g]}))
    a = poisson_glmm(df, "y", ["x"], ["g"])                 # diagonal path
    b = poisson_glmm(df, "y", ["x"], ["g"], dense=True)     # dense path
    c = poisson_glmm(df, "y", ["x"], ["g"], dense=False)    # diagonal driver path
    assert np.allclose(b.coef, c.coef, atol=1e-7) and math.isclose(b.loglik, c.loglik, rel_tol=1e-10)
    assert np.allclose(a.coef, b.coef, atol=1e-7) and np.allclose(a.se, b.se, rtol=1e-6)
    assert math.isclose(a.loglik, b.loglik, rel_tol=1e-10)
    assert math.isclose(a.sigma["g"], b.sigma["g"], rel_tol=1e-6)


def _crossed(seed, n, qa, qb, dates=None):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, qa, n), rng.integers(0, qb, n)
    x = rng.normal(size=n)
    eta = 0.2 + 0.4 * x + rng.normal(0, 0.6, qa)[a] + rng.normal(0, 0.3, qb)[b]
    cols = {"x": x, "a": [f"a{i}" for i in a], "b": [f"b{i}" for i in b]}
    if dates:
        c = rng.integers(0, dates, n)
        eta = eta + rng.normal(0, 0.4, dates)[c]
        cols["c"] = c
    return pd.DataFrame({"y": rng.poisson(np.exp(eta)), **cols})


@pytest.mark.parametrize("random", [["a", "b"], ["b", "a"], ["a", "b", "c"]])
def test_glmm_eliminated_factor_equals_dense(spark, random):
    from abundance.models.glmm import poisson_glmm
    df = spark.createDataFrame(_crossed(31, 1200, 30, 6, 4 if "c" in random else None)).repartition(4)
    f, g = poisson_glmm(df, "y", ["x"], random), poisson_glmm(df, "y", ["x"], random, dense=True)
    assert f.converged and math.isclose(f.loglik, g.loglik, rel_tol=1e-9)
    assert np.allclose(f.coef, g.coef, atol=2e-5) and np.allclose(f.se, g.se, rtol=1e-4)
    assert all(math.isclose(f.sigma[k], g.sigma[k], rel_tol=1e-3) for k in random)
    large = {r["level"]: r["mode"] for r in f.modes["a"].collect()}
    assert all(abs(large[k] - v) < 1e-3 for k, v in g.modes["a"].items())
    assert all(abs(f.modes["b"][k] - v) < 1e-3 for k, v in g.modes["b"].items())


def test_glmm_gradient_is_that_of_the_likelihood(spark):
    from abundance.models.design import build_design
    from abundance.models.glmm import _frame_with_factors
    from abundance.models.glmm_blocks import Blocks
    for random in (["a"], ["a", "b", "c"]):
        df = spark.createDataFrame(_crossed(7, 300, 20, 5, 3))
        frame, feats = _frame_with_factors(df, "y", build_design(df, ["x"]), random)
        blocks = Blocks(frame, feats, random, 100)
        at = np.array([0.1, 0.3, *[-0.8, -0.5, -1.1][:len(random)]])
        _, grad = blocks.evaluate(at[:2], at[2:])
        for i in range(len(at)):
            move = np.eye(len(at))[i] * 1e-4
            up, down = (blocks.evaluate((at + s * move)[:2], (at + s * move)[2:])[0] for s in (1, -1))
            assert math.isclose((up - down) / 2e-4, grad[i], rel_tol=1e-5, abs_tol=1e-5), (random, i)
        blocks.drop()


def test_glmm_with_a_large_crossed_factor(spark):
    from abundance.models.glmm import poisson_glmm
    f = poisson_glmm(spark.createDataFrame(_crossed(41, 60_000, 12_000, 8)), "y", ["x"], ["b", "a"], max_levels=100)
    assert f.converged and abs(f.sigma["a"] - 0.6) < 0.05 and abs(f.coef[1] - 0.4) < 4 * f.se[1]
    with pytest.raises(ValueError):
        poisson_glmm(spark.createDataFrame(_crossed(41, 300, 50, 8)), "y", ["x"], ["b", "a"], max_levels=5)


def test_glm_set_equals_separate_fits(spark):
    from abundance.models.glm import glm_set
    rng = np.random.default_rng(14)
    n = 600
    pdf = pd.DataFrame({"x": rng.normal(size=n), "z": rng.normal(size=n), "s": rng.choice(["a", "b", "c"], n), "sx": rng.normal(size=n)})
    pdf["y"] = rng.poisson(np.exp(0.3 + 0.4 * pdf.x + 0.2 * (pdf.s == "b"))).astype(float)
    df = spark.createDataFrame(pdf).withColumns({"x": F.when(F.rand(1) < 0.9, F.col("x")), "s": F.when(F.rand(2) < 0.9, F.col("s"))}).cache()
    specs = {"one": ["x"], "two": ["x", "s"], "three": ["x*z"], "four": ["s"], "five": ["sx", "x:s"], "six": []}
    for name, fit in glm_set(df, "y", specs).items():
        alone = glm(df, "y", specs[name])
        assert fit.names == alone.names and fit.n_used == alone.n_used, name
        assert np.allclose(fit.coef, alone.coef, atol=1e-8) and np.allclose(fit.se, alone.se, rtol=1e-6) and math.isclose(fit.loglik, alone.loglik)


def test_glmm_set_shares_its_jobs_and_equals_fits_with_distributed_cells(spark, monkeypatch):
    from abundance.models import glmm
    rng = np.random.default_rng(51)
    n = 1500
    a, b = rng.integers(0, 12, n), rng.integers(0, 5, n)
    x, z = rng.normal(0, 1, n), rng.normal(0, 1, n)
    y = rng.poisson(np.exp(0.3 + 0.4 * x + rng.normal(0, 0.5, 12)[a] + rng.normal(0, 0.3, 5)[b]))
    pdf = pd.DataFrame({"y": y, "x": x, "z": z, "a": [f"s{i}" for i in a], "b": b})
    pdf.loc[rng.random(n) < 0.05, "a"] = None
    pdf.loc[rng.random(n) < 0.05, "z"] = np.nan
    df = spark.createDataFrame(pdf)
    specs = {"one": (["x"], ["a"]), "crossed": (["x*z"], ["b", "a"])}
    spark.sparkContext.setJobGroup("glmm_set", "")
    fits = glmm.poisson_glmm_set(df, "y", specs)
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("glmm_set")) < 80     # hundreds where each step is a job
    monkeypatch.setattr(glmm, "CELLS", 0)
    for name, (terms, random) in specs.items():
        f, g = fits[name], glmm.poisson_glmm(df, "y", terms, random)
        assert f.names == g.names and f.n_used == g.n_used and f.converged and g.converged
        assert np.allclose(f.coef, g.coef, atol=1e-5) and np.allclose(f.se, g.se, rtol=1e-4) and f.aic == pytest.approx(g.aic, abs=1e-6)
        assert f.sigma == pytest.approx(g.sigma, abs=1e-4)
        for factor, m in f.modes.items():
            m, k = (dict(t.collect()) if hasattr(t, "collect") else t for t in (m, g.modes[factor]))
            assert m == pytest.approx(k, abs=1e-4)


def test_glm_by_group_fits_ordinary_groups_in_one_pass(spark, monkeypatch):
    from abundance.models import glm_groups
    rng = np.random.default_rng(61)
    g = np.repeat(np.arange(40), rng.integers(6, 40, 40))
    pdf = pd.DataFrame({"g": [f"k{i:02d}" for i in g], "x": rng.normal(size=len(g))})
    pdf["y"] = rng.poisson(np.exp(0.5 + 0.3 * pdf.x)).astype(float)
    spark.sparkContext.setJobGroup("by_group", "")
    out = glm_by_group(spark.createDataFrame(pdf.sample(frac=1, random_state=1)), "g", "y", ["x"])
    by = out.toPandas().set_index(["group", "term"])
    spark.sparkContext.setJobGroup("", "")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("by_group")) < 20      # dozens where each iteration is a pass
    # blocks end inside groups
    monkeypatch.setattr(glm_groups, "BLOCK", 30)
    rows = pd.DataFrame({"__g": pdf.g, "__y": pdf.y, "__lfact": [math.lgamma(v + 1) for v in pdf.y], "a": 1.0, "b": pdf.x})
    fit = glm_groups._fit_whole(["a", "b"], ["(Intercept)", "x"], "poisson", 1e-8, 25)
    cut = pd.concat(list(fit(rows.iloc[i:i + 11] for i in range(0, len(rows), 11)))).set_index(["group", "term"])
    assert len(by) == len(cut) == 80 and by.converged.all()
    assert np.allclose(by.sort_index()[["estimate", "se", "loglik"]], cut.sort_index()[["estimate", "se", "loglik"]], atol=1e-9)
    for name in ("k00", "k17", "k39"):
        alone = glm(spark.createDataFrame(pdf[pdf.g == name]), "y", ["x"])
        got = by.loc[name].loc[alone.names]
        assert np.allclose(got.estimate, alone.coef, atol=1e-9) and np.allclose(got.se, alone.se, rtol=1e-7)
        assert (got.n_used == alone.n_used).all() and (got.iterations == alone.iterations).all()


def test_full_subsets_shares_passes_and_sums_densities_by_value(spark, monkeypatch):
    from abundance.models import glm as glm_module
    from abundance.models.select import full_subsets
    from abundance.models.tweedie import tweedie_logpdf
    rng = np.random.default_rng(71)
    n, names = 400, list("abcdef")
    pdf = pd.DataFrame({c: rng.normal(size=n) for c in names} | {"response": rng.choice(["s", "t"], n)})
    pdf["y"] = np.where(pdf.response == "s", rng.poisson(np.exp(0.4 + 0.3 * pdf.a)), rng.gamma(2.0, np.exp(0.2 * pdf.b)))
    calls, plain = [], glm_module._sums_arrow
    monkeypatch.setattr(glm_module, "_sums_arrow", lambda *a, **k: calls.append(len(a[1])) or plain(*a, **k))
    ranked = full_subsets(spark.createDataFrame(pdf), "y", names, max_size=3, cor_cutoff=2.0, smooth=False, family="tweedie:1.5").models.toPandas()
    assert len(ranked) == 2 * 42 and calls[0] == 42 and len(calls) <= 14           # three batches of passes before
    for g, combo in (("s", ["a"]), ("t", ["b", "c"]), ("s", [])):
        some = pdf[pdf.response == g]
        fit = glm(spark.createDataFrame(some), "y", combo, family="tweedie:1.5")
        mu = np.exp(np.column_stack([np.ones(len(some)), *[some[c] for c in combo]]) @ fit.coef)
        want = tweedie_logpdf(some.y.to_numpy(), mu, fit.extra["dispersion"], 1.5).sum()
        got = ranked[(ranked.response == g) & (ranked.modname == ("+".join(combo) or "null"))].loglik.iloc[0]
        assert got == pytest.approx(want, rel=1e-8)
