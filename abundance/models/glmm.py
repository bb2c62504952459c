"""Random-intercept Poisson GLMM by the Laplace approximation (survey ID M3).

``glmer(y ~ x + (1|site) [+ (1|date)], family=poisson)``: one random
intercept per level of each grouping factor (one factor or crossed
factors), variances estimated, fixed effects by maximising the Laplace
approximation of the marginal likelihood (both stages, as with nAGQ = 1).

Data work: for a trial beta, one ``groupBy(factors).agg`` pass gives, per
cell of the factor levels, A = sum exp(x'b), B = sum exp(x'b) x,
C = sum exp(x'b) x x', sum y, sum y x and sum ln y!. With the random
effects u the conditional mean in a cell is exp(o_c) * exp(x'b), so the
cell table is a sufficient statistic for the modes of u, the variance
profile and the beta gradient. With one factor the cells are the levels;
they stay distributed and only sums reach the driver (``glmm_blocks``).
With crossed factors the largest is eliminated level by level in tasks.

Several models of one response (``poisson_glmm_set``) share the passes over
the rows. Where the factors have at most ``CELLS`` cells in all, a round is one
job: it sums every model's cells at its own trial beta, and the driver takes
each model a step on. With more cells each model runs by itself and its cells
stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.functions.stats import norm_two_sided_p
from abundance.models.design import INTERCEPT, build_design, design_columns, model_input
from abundance.models.glm import LF, Y, irls
from abundance.models.glmm_blocks import Blocks, FewCells, answer, maximise

CELLS = 4096            # cells of all factors whose sums the driver works on
SENT = 16_000_000       # bytes of tasks' sums that are added up on the driver


@dataclass
class GlmmFit:
    names: list[str]
    coef: np.ndarray
    cov: np.ndarray
    sigma: dict
    loglik: float
    n_used: int
    iterations: int
    converged: bool
    modes: dict                 # by factor: {level: mode}; a (level, mode) DataFrame for the largest factor

    @property
    def p(self) -> int:
        return len(self.coef) + len(self.sigma)

    @property
    def aic(self) -> float:
        return -2.0 * self.loglik + 2.0 * self.p

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def table(self) -> list[tuple]:
        rows = []
        for n, b, s in zip(self.names, self.coef, self.se):
            z = b / s if s > 0 else float("nan")
            rows.append((n, float(b), float(s), float(z), norm_two_sided_p(z) if s > 0 else float("nan")))
        return rows


class _Cells:
    """Cell statistics at one beta, plus the driver-side Laplace pieces."""

    def __init__(self, rows, feats, factors, level_index, dense: bool | None = None):
        p = len(feats)
        # one grouping factor: every cell is one level, so Z'WZ + D is diagonal
        self.diag = (len(factors) == 1) if dense is None else not dense
        self.n = len(rows)
        self.A = np.array([r["__A"] for r in rows], float)
        self.B = np.array([r["__B"] for r in rows], float).reshape(self.n, p)
        self.C = np.array([r["__C"] for r in rows], float).reshape(self.n, p, p)
        self.Sy = np.array([r["__Sy"] for r in rows], float)
        self.Yx = np.array([r["__Yx"] for r in rows], float).reshape(self.n, p)
        self.L = np.array([r["__L"] for r in rows], float)
        self.count = int(sum(r["__n"] for r in rows))
        self.q_f = [len(level_index[f]) for f in factors]
        offs = np.cumsum([0] + self.q_f)
        self.q = int(offs[-1])
        self.fac_of = np.concatenate([[k] * q for k, q in enumerate(self.q_f)]).astype(int)
        if self.diag:
            f = factors[0]
            self.level_of_cell = np.array([level_index[f][r[f]] for r in rows], int)
            self.Z = None
            return
        Z = np.zeros((self.n, self.q))
        for k, f in enumerate(factors):
            for c, r in enumerate(rows):
                Z[c, offs[k] + level_index[f][r[f]]] = 1.0
        self.Z = Z

    def _mode_diag(self, theta):
        """Single factor: one 1-D Newton per level, vectorized (O(q))."""
        d = float(np.exp(-2.0 * theta[0]))
        A = np.zeros(self.q)
        Sy = np.zeros(self.q)
        np.add.at(A, self.level_of_cell, self.A)
        np.add.at(Sy, self.level_of_cell, self.Sy)
        u = np.zeros(self.q)
        for _ in range(200):
            h = np.exp(u) * A
            step = (Sy - h - d * u) / (h + d)
            u = u + step
            if np.max(np.abs(step)) < 1e-10:
                break
        o = u[self.level_of_cell]
        h_cell = np.exp(o) * self.A
        mdiag = np.exp(u) * A + d
        return u, o, h_cell, mdiag, np.full(self.q, d)

    def mode(self, theta, u0=None):
        """Maximise sum Sy o - exp(o) A - u'Du/2 over u (Newton)."""
        if self.diag:
            return self._mode_diag(theta)
        dvec = np.exp(-2.0 * theta)[self.fac_of]          # 1 / sigma^2 per level
        u = np.zeros(self.q) if u0 is None else u0.copy()
        for _ in range(100):
            o = self.Z @ u
            h = np.exp(o) * self.A
            g = self.Z.T @ (self.Sy - h) - dvec * u
            M = (self.Z.T * h) @ self.Z + np.diag(dvec)
            step = np.linalg.solve(M, g)
            u = u + step
            if np.max(np.abs(step)) < 1e-10:
                break
        o = self.Z @ u
        h = np.exp(o) * self.A
        M = (self.Z.T * h) @ self.Z + np.diag(dvec)
        return u, o, h, M, dvec

    def laplace(self, beta, theta, u0=None):
        u, o, h, M, dvec = self.mode(theta, u0)
        if self.diag:
            logdet = float(np.sum(np.log(M)))
        else:
            sign, logdet = np.linalg.slogdet(M)
        ll = (float(self.Yx.sum(0) @ beta) + float(self.Sy @ o) - float(h.sum()) - float(self.L.sum())
              - 0.5 * float(dvec @ (u * u)) - 0.5 * float(np.sum(np.array(self.q_f) * 2.0 * theta)) - 0.5 * logdet)
        return ll, u, o, h, M

    def profile_theta(self, beta, theta0):
        """Maximise the Laplace likelihood over log sigma (Nelder-Mead)."""
        f = lambda t: -self.laplace(beta, np.clip(t, -12, 6))[0]
        return _nelder_mead(f, np.asarray(theta0, float))

    def beta_step(self, beta, theta):
        ll, u, o, h, M = self.laplace(beta, theta)
        eo = np.exp(o)
        EB = eo[:, None] * self.B                        # cells x p
        if self.diag:
            lv = self.level_of_cell
            ZEB = np.zeros((self.q, EB.shape[1]))
            np.add.at(ZEB, lv, EB)                           # q x p
            du = -ZEB / M[:, None]                            # q x p
            dh = EB + h[:, None] * du[lv]
            P = 1.0 / M[lv]
            grad = (self.Yx - EB).sum(0) - 0.5 * (P[:, None] * dh).sum(0)
            info = np.einsum("c,cjk->jk", eo, self.C) - (ZEB / M[:, None]).T @ ZEB
            return ll, grad, info, u
        Minv = np.linalg.inv(M)
        ZEB = self.Z.T @ EB                               # q x p
        du = -Minv @ ZEB                                  # q x p
        dh = EB + h[:, None] * (self.Z @ du)              # cells x p
        P = np.einsum("cq,qr,cr->c", self.Z, Minv, self.Z)
        grad = (self.Yx - EB).sum(0) - 0.5 * (P[:, None] * dh).sum(0)
        info = np.einsum("c,cjk->jk", eo, self.C) - ZEB.T @ Minv @ ZEB
        return ll, grad, info, u


def _nelder_mead(f, x0, tol=1e-9, max_iter=400):
    n = len(x0)
    pts = [x0] + [x0 + np.eye(n)[i] * 0.5 for i in range(n)]
    vals = [f(p) for p in pts]
    for _ in range(max_iter):
        order = np.argsort(vals)
        pts = [pts[i] for i in order]
        vals = [vals[i] for i in order]
        if abs(vals[-1] - vals[0]) < tol * (abs(vals[0]) + 1) and np.max(np.abs(pts[-1] - pts[0])) < 1e-6:
            break
        c = np.mean(pts[:-1], axis=0)
        xr = c + (c - pts[-1])
        fr = f(xr)
        if fr < vals[0]:
            xe = c + 2 * (c - pts[-1])
            fe = f(xe)
            pts[-1], vals[-1] = (xe, fe) if fe < fr else (xr, fr)
        elif fr < vals[-2]:
            pts[-1], vals[-1] = xr, fr
        else:
            xc = c + 0.5 * (pts[-1] - c)
            fc = f(xc)
            if fc < vals[-1]:
                pts[-1], vals[-1] = xc, fc
            else:
                pts = [pts[0]] + [pts[0] + 0.5 * (p - pts[0]) for p in pts[1:]]
                vals = [vals[0]] + [f(p) for p in pts[1:]]
    i = int(np.argmin(vals))
    return pts[i], vals[i]


def poisson_glmm(df: DataFrame, response: str, terms: Sequence[str], random: Sequence[str],
                 max_levels: int = 5000, max_cells: int = 200_000, max_iter: int = 60,
                 tol: float = 1e-10, checkpoint: bool = False, dense: bool | None = None) -> GlmmFit:
    """Fit. The factor with the most levels may have any number; the others
    together at most ``max_levels``, as their system is solved on the driver
    (``glmm_blocks``). ``dense`` True or False instead takes the whole model
    through the driver algebra of ``_Cells`` (all factors in one matrix, or
    the diagonal form of one factor), limited to ``max_levels`` per factor and
    ``max_cells`` cells: an independent form for small tables."""
    random = list(random)
    if dense is None:
        return poisson_glmm_set(df, response, {"model": (terms, random)}, max_levels, max_iter, tol, checkpoint)["model"]
    base = model_input(df, [response, *design_columns(terms), *random], checkpoint)
    try:
        d = build_design(base, terms)
        frame, feats = _frame_with_factors(base, response, d, random)
        start = irls(frame, [feats], [d.names], "poisson", max_iter=25, tol=1e-8)[0]
        return _fit_dense(frame, feats, d.names, random, start.coef, max_levels, max_cells, max_iter, tol, dense)
    finally:
        base.unpersist()


def poisson_glmm_set(df: DataFrame, response: str, specs: dict[str, tuple[Sequence[str], Sequence[str]]],
                     max_levels: int = 5000, max_iter: int = 60, tol: float = 1e-10, checkpoint: bool = False) -> dict[str, GlmmFit]:
    """Several models of one response (``{name: (terms, random)}``), each on
    the rows that are complete in its own columns, as if fitted alone."""
    specs = {name: (list(terms), list(random)) for name, (terms, random) in specs.items()}
    factors = list(dict.fromkeys(f for _, random in specs.values() for f in random))
    columns = list(dict.fromkeys(c for terms, _ in specs.values() for c in design_columns(terms)))
    base = model_input(df, [response, *columns, *factors], checkpoint)
    try:
        rows = base.dropna(subset=[response] if len(specs) > 1 else None)
        cells = rows.groupBy(*factors).count().drop("count").limit(CELLS + 1).collect()
        if len(cells) <= CELLS:
            return _fit_cells(base, rows, response, specs, factors, cells, max_levels, max_iter, tol)
        if len(specs) > 1:
            return {name: poisson_glmm(base, response, *spec, max_levels, max_iter=max_iter, tol=tol) for name, spec in specs.items()}
        (name, (terms, random)), = specs.items()
        d = build_design(base, terms)
        frame, feats = _frame_with_factors(base, response, d, random)
        start = irls(frame, [feats], [d.names], "poisson", max_iter=4, tol=1e-3)[0]
        blocks = Blocks(frame, feats, random, max_levels)
        return {name: answer(_fitting(blocks, d.names, start.coef, max_iter, tol), blocks.table)}
    finally:
        base.unpersist()


def _fitting(blocks: Blocks, names: list[str], beta, max_iter: int, tol: float):
    """The steps of one model's fit (see ``maximise``)."""
    beta, theta, ll, it, converged = yield from maximise(blocks, beta, max_iter, tol)
    cov = np.linalg.inv((yield from blocks.informing(beta, theta)))
    sigma = {f: float(np.exp(t)) for f, t in zip(blocks.random, theta)}
    return GlmmFit(names, beta, cov, sigma, float(ll), blocks.count, it, converged, blocks.mode_tables(beta, theta))


def _fit_cells(base, rows, response, specs, factors, cells, max_levels, max_iter, tol) -> dict[str, GlmmFit]:
    """All models in rounds of one job each (see above). A model's intercept
    is missing in the rows that are not complete in its columns."""
    import pandas as pd
    from abundance.functions.columns import ln_factorial
    levels, designs, index, cols, feats = {}, {}, {}, [], {}
    for name, (terms, random) in specs.items():
        d = designs[name] = build_design(base, terms, levels=levels)
        levels.update(d.levels)
        needed = sorted({*d.columns, *random})
        feats[name] = []
        for n, e in zip(d.names, d.exprs):
            key = n, tuple(needed) if n == INTERCEPT else ()
            if key not in index:
                index[key] = f"__x{len(index)}"
                missing = F.lit(False)
                for c in key[1]:
                    missing = missing | F.col(c).isNull()
                cols.append(F.when(~missing, e).alias(index[key]))
            feats[name].append(index[key])
    numbers = rows.sparkSession.createDataFrame(
        [(*c, i) for i, c in enumerate(cells)], ", ".join([*[f"`__f{i}` {dict(rows.dtypes)[f]}" for i, f in enumerate(factors)], "__c int"]))
    same = F.lit(True)
    for i, f in enumerate(factors):
        same = same & F.col(f).eqNullSafe(F.col(f"__f{i}"))
    frame = (rows.join(F.broadcast(numbers), same)
             .select(F.col(response).cast("double").alias(Y), ln_factorial(F.col(response)).alias(LF), "__c", *cols).cache())
    try:
        starts = irls(frame, list(feats.values()), [d.names for d in designs.values()], "poisson", max_iter=4, tol=1e-3)
        first = _cell_sums(frame, {name: (f, None, False) for name, f in feats.items()}, len(cells))
        labels = pd.DataFrame({f: pd.Series([c[f] for c in cells], dtype=object) for f in factors})
        blocks, steps, ask, fits = {}, {}, {}, {}
        for (name, (_, random)), start in zip(specs.items(), starts):
            v = first[name]
            b = FewCells(labels.assign(n=v[:, 0], Sy=v[:, 1]), float(v[:, 2].sum()), v[:, 3:].sum(0), feats[name], random, dict(base.dtypes), max_levels)
            blocks[name], steps[name] = b, _fitting(b, designs[name].names, start.coef, max_iter, tol)
            ask[name] = next(steps[name])
        while ask:
            got = _cell_sums(frame, {name: (feats[name], *a) for name, a in ask.items()}, len(cells))
            for name in list(ask):
                try:
                    ask[name] = steps[name].send(blocks[name].frame_of(got[name], ask[name][1]))
                except StopIteration as end:
                    fits[name] = end.value
                    del ask[name]
        return {name: fits[name] for name in specs}
    finally:
        frame.unpersist()


def _cell_sums(frame: DataFrame, ask: dict, cells: int) -> dict[str, np.ndarray]:
    """One pass over the rows. ``ask``: {model: (features, beta, second)};
    per model a matrix with a row per cell: sum e, e x and (``second``) e x x'
    with e = exp(x'beta), or, where beta is None, the count and the sums of y,
    ln y! and y x. Tasks add up; their sums meet on the driver, or, where
    they are many, first by blocks of cells."""
    used = sorted({f for fs, *_ in ask.values() for f in fs})
    models = [([used.index(f) for f in fs], beta, second) for fs, beta, second in ask.values()]
    sizes = [len(ix) + (3 if beta is None else 1 + second * len(ix) ** 2) for ix, beta, second in models]
    width = sum(sizes)
    block = max(1, 16_384 // width)

    def part(batches):
        import pandas as pd
        total = np.zeros((cells, width))
        for pdf in batches:
            c, y, lf = pdf["__c"].to_numpy(), pdf[Y].to_numpy(float), pdf[LF].to_numpy(float)
            X_all = pdf[used].to_numpy(float)
            at = 0
            for ix, beta, second in models:
                X = X_all[:, ix]
                there = ~np.isnan(X).any(axis=1)
                X = np.where(there[:, None], X, 0.0)
                if beta is None:
                    parts = [there, there * y, there * lf, *(X * y[:, None]).T]
                else:
                    e = np.where(there, np.exp(X @ beta), 0.0)
                    eX = X * e[:, None]
                    parts = [e, *eX.T]
                    parts += [eX[:, j] * X[:, k] for j in range(len(ix)) for k in range(len(ix))] if second else []
                for v in parts:
                    total[:, at] += np.bincount(c, v, cells)
                    at += 1
        starts = range(0, cells, block)
        yield pd.DataFrame({"k": list(starts), "v": [total[i:i + block].ravel().tolist() for i in starts]})

    def add(pdf):
        import pandas as pd
        return pd.DataFrame({"k": pdf["k"].iloc[:1].to_list(), "v": [np.sum(np.stack([np.asarray(v, float) for v in pdf["v"]]), 0).tolist()]})

    schema = "k int, v array<double>"
    sums = frame.select(Y, LF, "__c", *used).mapInPandas(part, schema)
    if frame.rdd.getNumPartitions() * cells * width * 8 > SENT:
        sums = sums.groupBy("k").applyInPandas(add, schema)
    out = np.zeros((cells, width))
    for r in sums.collect():
        out[r["k"]:r["k"] + block] += np.array(r["v"], float).reshape(-1, width)
    return dict(zip(ask, np.split(out, np.cumsum(sizes)[:-1], axis=1)))


def _fit_dense(frame, feats, names, random, beta, max_levels, max_cells, max_iter, tol, dense) -> GlmmFit:
    levels = {}
    for f in random:
        lv = frame.select(f).distinct().limit(max_levels + 1).collect()
        if len(lv) > max_levels:
            raise ValueError(f"{f}: more than {max_levels} levels")
        levels[f] = {r[f]: i for i, r in enumerate(sorted(lv, key=lambda r: str(r[f])))}
    p = len(feats)

    def cells(beta):
        eta = F.lit(0.0)
        for b, c in zip(beta, feats):
            eta = eta + F.lit(float(b)) * F.col(c)
        e = F.exp(eta)
        X = [F.col(c) for c in feats]
        agg = (frame.groupBy(*random).agg(
            F.sum(e).alias("__A"),
            F.array(*[F.sum(e * x) for x in X]).alias("__B"),
            F.array(*[F.sum(e * X[j] * X[k]) for j in range(p) for k in range(p)]).alias("__C"),
            F.sum(Y).alias("__Sy"),
            F.array(*[F.sum(F.col(Y) * x) for x in X]).alias("__Yx"),
            F.sum(LF).alias("__L"), F.count(F.lit(1)).alias("__n")))
        rows = agg.limit(max_cells + 1).collect()
        if len(rows) > max_cells:
            raise ValueError(f"more than {max_cells} factor cells")
        return _Cells(rows, feats, random, levels, dense)

    theta = np.zeros(len(random))
    cs = cells(beta)
    theta, _ = cs.profile_theta(beta, theta)
    ll, grad, info, u = cs.beta_step(beta, theta)
    it, converged = 0, False
    while it < max_iter and not converged:
        it += 1
        step = np.linalg.solve(info, grad)
        t = 1.0
        for _ in range(30):
            cand = beta + t * step
            cs2 = cells(cand)
            th2, neg2 = cs2.profile_theta(cand, theta)
            if -neg2 >= ll - 1e-10 * abs(ll):
                break
            t /= 2
        else:
            break                       # no step raises the likelihood: stay, not converged
        dll = -neg2 - ll
        beta, theta, cs = cand, th2, cs2
        ll, grad, info, u = cs.beta_step(beta, theta)
        converged = abs(dll) < tol * (abs(ll) + 1) and np.max(np.abs(t * step)) < 1e-6
    offs = np.cumsum([0] + [len(levels[f]) for f in random])
    modes = {f: {lv: float(u[offs[k] + i]) for lv, i in levels[f].items()} for k, f in enumerate(random)}
    return GlmmFit(names, beta, np.linalg.inv(info), {f: float(np.exp(theta[k])) for k, f in enumerate(random)},
                   float(ll), cs.count, it, converged, modes)


def _frame_with_factors(df, response, d, random):
    from abundance.functions.columns import ln_factorial
    cols = [F.col(response).cast("double").alias(Y), ln_factorial(F.col(response)).alias(LF)]
    feats = []
    for i, e in enumerate(d.exprs):
        cols.append(e.alias(f"__x{i}"))
        feats.append(f"__x{i}")
    base = df.dropna(subset=sorted(set(d.columns) | {response} | set(random)))
    return base.select(*cols, *[F.col(f) for f in random]), feats
