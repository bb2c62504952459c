"""One GLM per group, for any number of groups (survey ID M10).

Groups of an ordinary size are fitted whole inside tasks: their rows are laid
out once, sorted by group, and every task takes blocks of groups through all
their passes in numpy, the sums of a block's groups taken side by side. That is
one shuffle of the rows and no state on disk, however many groups there are.

Hot groups (more rows than one in ``SHARE`` of all and than ``SMALL``, or than
``LARGE``) never meet in one task. Their state is a table: one row per group
with its coefficients. A pass joins the rows with their group's coefficients, sums X'WX, X'Wz, deviance and
log-likelihood per group (JVM sums that combine before their shuffle) and
solves the p x p systems of the groups batch by batch. Groups that have
converged leave; the others' new state is written to the shared folder.
Nothing of a group reaches the driver, only the number of groups still active.

Their rows are laid out once by (group, salt), so that each is spread over
tasks in every pass, and its state row is repeated once a salt. The generated code is the same in every
pass, as coefficients are columns and not constants.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.functions.stats import norm_two_sided_p
from abundance.models.design import build_design, design_columns, model_input
from abundance.models.glm import ETA_MAX, LF, Y, _family_parts, _start_eta, _variance, family_arrays, model_frame
from abundance.session import cut_lineage, write_table

SHARE = 10_000          # more than one row in this many makes a group hot: at most this many hot groups
SMALL, LARGE = 1_000, 1_000_000     # rows up to which a group is never, and from which it is always, hot
BLOCK = 50_000          # rows whose groups are fitted side by side
ACTIVE, CONVERGED, FAILED = 0, 1, 2


def _layout(frame: DataFrame):
    """The rows of hot groups by (group, salt), the table of hot groups, and
    the other groups' rows, each group's side by side in one partition."""
    spark = frame.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = min(max(frame.count() // SHARE, SMALL), LARGE)
    hot = cut_lineage(frame.groupBy("__g").agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
                      .select("__g", F.lit(True).alias("__hot")))
    if hot.isEmpty():
        return None, hot, frame.repartition(n, "__g").sortWithinPartitions("__g")
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    rows = frame.join(F.broadcast(hot), "__g", "left_semi").withColumn("__salt", salt).repartition(n, "__g", "__salt")
    return rows.cache(), hot, frame.join(F.broadcast(hot), "__g", "left_anti").repartition(n, "__g").sortWithinPartitions("__g")


def _pass(rows: DataFrame, state: DataFrame, feats: list[str], family: str) -> DataFrame:
    """(__g, __v): the sums of each active group at its coefficients."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = state.select("__g", "__beta", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__salt"))
    y, xs = F.col(Y), [F.col(f) for f in feats]
    eta = F.lit(0.0)
    for j, x in enumerate(xs):
        eta = eta + F.col("__beta")[j] * x
    eta = F.when(F.col("__beta").isNull(), _start_eta(family, y)).otherwise(eta)
    data = rows.join(told, ["__g", "__salt"]).withColumn("__eta", F.least(F.greatest(eta, F.lit(-ETA_MAX)), F.lit(ETA_MAX)))
    e = F.col("__eta")
    w, wz, dev, ll = _family_parts(family, e, y)
    mu = (F.lit(1.0) / (F.lit(1.0) + F.exp(-e))) if family == "binomial" else F.exp(e)
    pear = (y - mu) * (y - mu) / F.greatest(_variance(family, mu), F.lit(1e-300))
    data = data.withColumns({"__w": w, "__wz": wz, "__d": dev, "__l": ll, "__p": pear})
    sums = [F.sum(F.col("__w") * xs[j] * xs[k]) for j in range(len(xs)) for k in range(j, len(xs))]
    sums += [F.sum(F.col("__wz") * x) for x in xs] + [F.sum("__d"), F.sum("__l"), F.count(F.lit(1)), F.sum("__p")]
    return data.groupBy("__g").agg(F.array(*[s.cast("double") for s in sums]).alias("__v"))


def _matrices(v: np.ndarray, p: int):
    """(X'WX, X'Wz, deviance, log-likelihood, n, Pearson sum) of many groups."""
    m = np.zeros((len(v), p, p))
    i, j = np.triu_indices(p)
    m[:, i, j] = m[:, j, i] = v[:, :len(i)]
    return m, v[:, len(i):len(i) + p], *v[:, len(i) + p:].T


def _inverses(m: np.ndarray) -> np.ndarray:
    m = np.nan_to_num(m, nan=0.0, posinf=0.0, neginf=0.0)
    try:
        return np.linalg.inv(m)
    except np.linalg.LinAlgError:                   # a group whose terms are collinear: minimum norm
        out = np.empty_like(m)
        for k, a in enumerate(m):
            try:
                out[k] = np.linalg.inv(a)
            except np.linalg.LinAlgError:
                out[k] = np.linalg.pinv(a)
        return out


def _advance(p: int, tol: float, last_pass: bool):
    """Function of batches: the state after a pass (the rule of ``irls``)."""
    def run(batches):
        for pdf in batches:
            k = len(pdf)
            xtwx, xtwz, dev, *_ = _matrices(np.array(pdf["__v"].tolist(), float).reshape(k, -1), p)
            had = pdf["__dev"].notna().to_numpy()
            old = pdf["__dev"].to_numpy(float)
            beta = np.array([np.zeros(p) if b is None else b for b in pdf["__beta"]], float).reshape(k, p)
            last = np.array([np.full(p, np.nan) if b is None else b for b in pdf["__last"]], float).reshape(k, p)
            halved, it = pdf["__halved"].to_numpy().copy(), pdf["__it"].to_numpy().copy()
            worse = had & ~(dev <= old + 1e-6 * (np.abs(old) + 0.1))
            halve = worse & ~np.isnan(last).any(1) & (halved < 12) & (not last_pass)
            bad = ~halve & ~np.isfinite(dev)
            met = ~halve & ~bad & had & (np.abs(dev - old) / (np.abs(dev) + 0.1) < tol)
            step = ~halve & ~bad & ~met & (not last_pass)
            new = beta.copy()
            new[halve] = (beta[halve] + last[halve]) / 2
            if step.any():
                new[step] = np.einsum("kij,kj->ki", _inverses(xtwx[step]), xtwz[step])
            halved = np.where(halve, halved + 1, np.where(step, 0, halved))
            status = np.where(halve | step, ACTIVE, np.where(met, CONVERGED, FAILED))
            first = pdf["__beta"].isna().to_numpy()
            pdf["__last"] = [None if s and f else (b if s else x).tolist() if not np.isnan(b if s else x).any() else None
                             for s, f, b, x in zip(step, first, beta, last)]
            pdf["__beta"] = [b.tolist() if a or not f else None for a, f, b in zip(halve | step, first, new)]
            pdf["__dev"] = np.where(step | met | bad, dev, old)
            pdf["__halved"], pdf["__it"], pdf["__status"] = halved, np.where(step, it + 1, it), status.astype("int32")
            yield pdf

    return run


def _report(names: list[str], family: str):
    """Function of batches: coefficient rows of finished groups."""
    p = len(names)

    def run(batches):
        import pandas as pd
        for pdf in batches:
            k = len(pdf)
            xtwx, _, dev, ll, n, pear = _matrices(np.array(pdf["__v"].tolist(), float).reshape(k, -1), p)
            beta = np.array([np.zeros(p) if b is None else b for b in pdf["__beta"]], float).reshape(k, p)
            phi = np.where(n > p, pear / np.maximum(n - p, 1), 1.0) if family.startswith("tweedie:") else np.ones(k)
            se = np.sqrt(np.clip(np.einsum("kii->ki", _inverses(xtwx)) * phi[:, None], 0, None))
            z = np.where(se > 0, beta / np.where(se > 0, se, 1), np.nan)
            rep = lambda a: np.repeat(a, p)
            yield pd.DataFrame({
                "group": rep(pdf["__g"].to_numpy()), "term": names * k, "estimate": beta.ravel(), "se": se.ravel(), "z": z.ravel(),
                "p": [norm_two_sided_p(x) if np.isfinite(x) else np.nan for x in z.ravel()], "n_used": rep(n).astype("int64"),
                "deviance": rep(dev), "loglik": rep(ll), "aic": rep(-2 * ll + 2 * p), "iterations": rep(pdf["__it"].to_numpy()),
                "converged": rep((pdf["__status"] == CONVERGED).to_numpy())})

    return run


def _fit_block(pdf, feats: list[str], family: str, tol: float, max_iter: int):
    """The groups of a block of rows (sorted by group), taken through all
    their passes; yields the state of groups as they finish."""
    import pandas as pd
    p = len(feats)
    g, y, lf = pdf["__g"], pdf[Y].to_numpy(float), pdf[LF].to_numpy(float)
    X = np.ascontiguousarray(pdf[feats].to_numpy(float))
    starts = np.flatnonzero((g != g.shift()).to_numpy())
    sizes = np.diff(np.append(starts, len(pdf)))
    k = len(starts)
    state = pd.DataFrame({"__g": g.iloc[starts].to_numpy(), "__beta": pd.Series([None] * k, dtype=object), "__last": pd.Series([None] * k, dtype=object),
                          "__dev": np.full(k, np.nan), "__halved": np.zeros(k, "int32"), "__it": np.zeros(k, "int32")})
    first, second = np.triu_indices(p)
    for it in range(max_iter + 1):
        if it:
            eta = np.einsum("ij,ij->i", X, np.repeat(np.array(state["__beta"].tolist(), float).reshape(-1, p), sizes, axis=0))
            eta = np.where(np.isnan(eta), ETA_MAX, np.clip(eta, -ETA_MAX, ETA_MAX))
        else:                                       # as ``_start_eta``: no logarithm, the lowest value
            at = y + 0.1 if family != "binomial" else (y + 0.5) / (1.5 - y)
            eta = np.clip(np.where(at > 0, np.log(np.where(at > 0, at, 1.0)), -ETA_MAX), -ETA_MAX, ETA_MAX)
        w, wz, dev, ll, pear = family_arrays(family, eta, y, lf)
        if family == "poisson":
            ll = np.where(np.isnan(lf), 0.0, ll)
        offsets = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        columns = [w * X[:, a] * X[:, b] for a, b in zip(first, second)] + [wz * X[:, a] for a in range(p)] + [dev, ll, np.ones(len(y)), pear]
        state["__v"] = np.stack([np.add.reduceat(c, offsets) for c in columns], 1).tolist()
        state = next(_advance(p, tol, it == max_iter)(iter([state])))
        active = (state["__status"] == ACTIVE).to_numpy()
        yield state[~active]
        if not active.any():
            return
        stay = np.repeat(active, sizes)
        y, lf, X, sizes = y[stay], lf[stay], X[stay], sizes[active]
        state = state[active].drop(columns=["__v", "__status"]).reset_index(drop=True)


def _fit_whole(feats: list[str], names: list[str], family: str, tol: float, max_iter: int):
    """Function of batches of rows sorted by group: coefficient rows."""
    def run(batches):
        import pandas as pd
        held, size = [], 0
        report = _report(names, family)

        def fitted(pdf):
            yield from report(s for s in _fit_block(pdf, feats, family, tol, max_iter) if len(s))

        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= BLOCK:
                pdf = pd.concat(held, ignore_index=True)
                last = int(np.flatnonzero((pdf["__g"] != pdf["__g"].shift()).to_numpy())[-1])   # its rows may go on
                if last:
                    yield from fitted(pdf.iloc[:last])
                held, size = [pdf.iloc[last:]], 0 if last else size // 2
        if held:
            pdf = pd.concat(held, ignore_index=True)
            if len(pdf):
                yield from fitted(pdf)

    return run


def glm_by_group(df: DataFrame, group: str, response: str, terms: Sequence[str], family: str = "poisson",
                 levels: dict | None = None, max_iter: int = 25, tol: float = 1e-8, checkpoint: bool = False) -> DataFrame:
    """One fit of the same terms per value of ``group``, as coefficient rows:
    group, term, estimate, se, z, p, n_used, deviance, loglik, aic,
    iterations, converged. Rows with a missing model variable or group drop
    (T19); a group without rows left is not in the result. Convergence and
    step halving follow ``irls``, group by group."""
    base = model_input(df, [group, response, *design_columns(terms)], checkpoint)
    d = build_design(base, terms, True, levels)
    frame, feats = model_frame(base, response, [d], None, group)
    rows, hot, others = _layout(frame)
    kind = dict(frame.dtypes)["__g"]
    out = ("group {}, term string, estimate double, se double, z double, p double, n_used long, deviance double, loglik double, "
           "aic double, iterations int, converged boolean").format(kind)
    fits = write_table(others.mapInPandas(_fit_whole(feats[0], d.names, family, tol, max_iter), out))
    if rows is not None:
        fits = fits.unionByName(_fit_hot(rows, hot, feats[0], family, tol, max_iter).mapInPandas(_report(d.names, family), out))
        rows.unpersist()
    base.unpersist()
    return fits


def _fit_hot(rows: DataFrame, hot: DataFrame, feats: list[str], family: str, tol: float, max_iter: int) -> DataFrame:
    """The finished state of the hot groups."""
    kind, p = dict(rows.dtypes)["__g"], len(feats)
    none = F.lit(None).cast("array<double>")
    state = hot.select("__g", none.alias("__beta"), none.alias("__last"), F.lit(None).cast("double").alias("__dev"),
                       F.lit(0).alias("__halved"), F.lit(0).alias("__it"))
    schema = f"__g {kind}, __beta array<double>, __last array<double>, __dev double, __halved int, __it int, __v array<double>, __status int"
    done = None
    for it in range(max_iter + 1):
        sums = _pass(rows, state, feats, family)
        moved = write_table(state.join(sums, "__g").withColumn("__status", F.lit(ACTIVE))
                            .select("__g", "__beta", "__last", "__dev", "__halved", "__it", "__v", "__status")
                            .mapInPandas(_advance(p, tol, it == max_iter), schema))
        ready = moved.where(F.col("__status") != ACTIVE)
        done = ready if done is None else done.unionByName(ready)
        state = moved.where(F.col("__status") == ACTIVE).drop("__v", "__status")
        if state.isEmpty():
            break
    return done
