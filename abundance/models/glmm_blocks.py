"""Laplace likelihood of a random-intercept Poisson GLMM with the largest
factor eliminated level by level (see ``glmm``).

Let M = Z'HZ + D be the Hessian of the random effects. The block of the factor
with the most levels is diagonal, so with the other factors' effects given,
each of its levels has a one-dimensional mode that a task finds by itself, and
it leaves its part of the Schur complement S = R - N' D1^-1 N behind, where R
is the other factors' block, N the cross block and D1 the diagonal. Tasks add
their parts up; the driver sees S and vectors of the other factors' length,
never the large factor's levels or the cells. log|M| = sum log D1 + log|S|.

The gradient in the fixed effects and the log standard deviations is exact:
the derivative of log|M| through the modes is found by one adjoint solve with
the same blocks (two more passes; none beyond the first for one factor), so
the likelihood is maximised by quasi-Newton steps over all parameters at once.

The steps are generators that yield (beta, second) where they need the cells'
sums at beta, so that several models' tables can come from one pass over the
rows. Where a model's cells are few (``FewCells``), the driver adds their sums
up by the same algebra, which saves the jobs of every Newton step.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.models.glm import LF, Y

LEVELS = 512            # levels whose cross block is dense at a time
FEW = 64                # other levels up to which tasks' sums are added on the driver
LOW, HIGH = -12.0, 6.0  # range of a log standard deviation


def level_modes(A, Sy, d):
    """Modes of Sy u - A exp(u) - d u^2 / 2, elementwise (Newton steps of at
    most 4, so that exp stays in range)."""
    u = np.zeros_like(A)
    for _ in range(300):
        h = np.exp(u) * A
        step = np.clip((Sy - h - d * u) / (h + d), -4.0, 4.0)
        u = u + step
        if len(step) == 0 or np.max(np.abs(step)) < 1e-11:
            break
    return u


class _Batch:
    """Some levels of the large factor, with their cells laid end to end."""

    def __init__(self, pdf, k: int, p: int, u, d: float):
        sizes = np.array([len(a) for a in pdf["A"]], int)
        flat = lambda c: np.concatenate([np.asarray(x, float) for x in pdf[c]]) if len(pdf) else np.zeros(0)
        self.m, self.lev = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
        self.J = flat("J").astype(int).reshape(-1, k) if k else np.zeros((len(self.lev), 0), int)
        self.Sy, self.B = flat("Sy"), flat("B").reshape(-1, p)
        o = u[self.J].sum(1) if k else np.zeros(len(self.lev))
        A = flat("A") * np.exp(o)
        self.d, self.u1 = d, level_modes(np.bincount(self.lev, A, self.m), np.bincount(self.lev, self.Sy, self.m), d)
        self.o = o + self.u1[self.lev]
        self.h = A * np.exp(self.u1[self.lev])
        self.D1 = np.bincount(self.lev, self.h, self.m) + d
        self.q = len(u)

    def by_level(self, x):
        return np.bincount(self.lev, x, self.m)

    def by_other(self, x):
        out = np.zeros(self.q)
        for k in range(self.J.shape[1]):
            out += np.bincount(self.J[:, k], x, self.q)
        return out

    def cross(self, x):
        """The dense (levels x other levels) matrix of cell values."""
        out = np.zeros((self.m, self.q))
        for k in range(self.J.shape[1]):
            np.add.at(out, (self.lev, self.J[:, k]), x)
        return out

    def adjoint(self, V):
        """P (the cells' diagonal of Z M^-1 Z'), the diagonal of M^-1 for the
        levels, a = Z'(P h) for levels and others, and N."""
        N = self.cross(self.h)
        T = N @ V
        m11 = 1 / self.D1 + (T * N).sum(1) / self.D1 ** 2
        P = m11[self.lev]
        for a in range(self.J.shape[1]):
            P = P - 2 * T[self.lev, self.J[:, a]] / self.D1[self.lev]
            for b in range(self.J.shape[1]):
                P = P + V[self.J[:, a], self.J[:, b]]
        return P, m11, self.by_level(P * self.h), self.by_other(P * self.h), N


def answer(steps, table):
    """The result of ``steps`` (a generator), with each (beta, second) it
    yields answered by ``table(beta, second)``."""
    reply = None
    try:
        while True:
            reply = table(*steps.send(reply))
    except StopIteration as end:
        return end.value


def _added(tables, k: int, p: int, u, d: float, work) -> dict:
    """``work``'s vectors over batches of levels, added up by key."""
    acc: dict = {}
    for pdf in tables:
        for i in range(0, len(pdf), LEVELS):
            some = pdf.iloc[i:i + LEVELS]
            for key, v in work(_Batch(some, k, p, u, d), some).items():
                acc[key] = acc[key] + v if key in acc else v
    return acc


class Blocks:
    """The model's rows with the factors sorted into the large one and the
    others; evaluates the Laplace log-likelihood and its gradient."""

    def __init__(self, frame: DataFrame, feats: list[str], random: list[str], max_other: int):
        self.feats, self.random, self.p = feats, random, len(feats)
        n = frame.agg(*[F.count_distinct(f).alias(f"q{i}") for i, f in enumerate(random)], F.count(F.lit(1)).alias("n"), F.sum(LF).alias("L"),
                      F.array(*[F.sum(F.col(Y) * F.col(c)) for c in feats]).alias("Yx")).first()
        self.q_of = {f: int(n[f"q{i}"]) for i, f in enumerate(random)}
        self.count, self.L, self.Yx = int(n["n"]), float(n["L"] or 0.0), np.array([x or 0.0 for x in n["Yx"]], float)
        self.large = max(random, key=lambda f: (self.q_of[f], -random.index(f)))
        self.others = [f for f in random if f != self.large]
        if sum(self.q_of[f] for f in self.others) > max_other:
            raise ValueError(f"the factors beside the largest have more than {max_other} levels in all")
        self.levels, self.q, at = {}, 0, frame
        for k, f in enumerate(self.others):                               # at most max_other levels in all
            known = sorted((r[0] for r in frame.select(f).distinct().collect()), key=str)
            self.levels[f] = {lv: self.q + i for i, lv in enumerate(known)}
            index = frame.sparkSession.createDataFrame([(lv, self.q + i) for i, lv in enumerate(known)], f"`__f{k}` {dict(frame.dtypes)[f]}, `__j{k}` int")
            at = at.join(F.broadcast(index), F.col(f) == F.col(f"__f{k}"))
            self.q += len(known)
        self.frame = at.select(Y, *feats, F.col(self.large).alias("__level"), *[f"__j{k}" for k in range(len(self.others))]).cache()
        self.u = np.zeros(self.q)
        self.spread: dict = {}          # per factor, the log sd of the modes and their variances (an EM step)

    def drop(self):
        self.frame.unpersist()

    def table(self, beta, second: bool = False) -> DataFrame:
        """Per level of the large factor, its cells' sums at ``beta``."""
        eta = F.lit(0.0)
        for b, c in zip(beta, self.feats):
            eta = eta + F.lit(float(b)) * F.col(c)
        rows = self.frame.withColumn("__e", F.exp(eta))
        e, X, j = F.col("__e"), [F.col(c) for c in self.feats], [f"__j{k}" for k in range(len(self.others))]
        sums = [F.sum(e).alias("A"), F.sum(Y).alias("Sy"), F.array(*[F.sum(e * x) for x in X]).alias("B")]
        sums += [F.array(*[F.sum(e * a * b) for a in X for b in X]).alias("C")] if second else []
        cells = rows.groupBy("__level", *j).agg(*sums)
        if not j:                                                          # a level is one cell
            return cells.select("__level", F.array("A").alias("A"), F.array("Sy").alias("Sy"), *("B", "C")[:1 + second])
        lists = [F.collect_list(c).alias(c) for c in ("A", "Sy")] + [F.flatten(F.collect_list(c)).alias(c) for c in ("B", "C")[:1 + second]]
        lists.append(F.flatten(F.collect_list(F.array(*j))).alias("J"))
        return cells.groupBy("__level").agg(*lists)

    def totals(self, table: DataFrame, theta, work) -> dict[int, np.ndarray]:
        """``work(batch) -> {key: vector}`` over batches of levels, added up
        per task and then per key; the driver gets one vector a key (with few
        other levels, one a key and task)."""
        k, p, u, d = len(self.others), self.p, self.u, self.precision(theta)[self.large]

        def part(batches):
            import pandas as pd
            acc = _added(batches, k, p, u, d, work)
            if acc:
                yield pd.DataFrame({"k": list(acc), "v": [np.atleast_1d(v).tolist() for v in acc.values()]})

        def add(pdf):
            import pandas as pd
            return pd.DataFrame({"k": pdf["k"].iloc[:1].to_list(), "v": [np.sum(np.stack([np.asarray(v, float) for v in pdf["v"]]), 0).tolist()]})

        schema = "k int, v array<double>"
        sums = table.mapInPandas(part, schema)
        if self.q > FEW:
            sums = sums.groupBy("k").applyInPandas(add, schema)
        out: dict = {}
        for r in sums.collect():
            v = np.array(r["v"], float)
            out[r["k"]] = out[r["k"]] + v if r["k"] in out else v
        return out

    def precision(self, theta) -> dict:
        return {f: float(np.exp(-2.0 * t)) for f, t in zip(self.random, theta)}

    def other_precisions(self, theta) -> np.ndarray:
        d = self.precision(theta)
        return np.concatenate([np.full(self.q_of[f], d[f]) for f in self.others]) if self.others else np.zeros(0)

    def modes(self, table: DataFrame, theta):
        """Newton steps on the other factors' effects until they stand still;
        returns the likelihood's sums there and S."""
        D = self.other_precisions(theta)

        def work(b, _):
            out = {-1: np.array([b.Sy @ b.o - b.h.sum() - 0.5 * b.d * (b.u1 @ b.u1), np.log(b.D1).sum()])}
            if b.q:
                N = b.cross(b.h)
                S = -N.T @ (N / b.D1[:, None])
                for x in range(b.J.shape[1]):
                    for y in range(b.J.shape[1]):
                        np.add.at(S, (b.J[:, x], b.J[:, y]), b.h)
                out[-2] = b.by_other(b.Sy - b.h)
                out.update({i: S[i] for i in range(b.q)})
            return out

        last = None
        for _ in range(60):
            t = self.totals(table, theta, work)
            if not self.q:
                return t.get(-1, np.zeros(2)), np.zeros((0, 0))
            S = np.stack([t[i] for i in range(self.q)]) + np.diag(D)
            value = t[-1][0] - 0.5 * D @ (self.u * self.u)
            if last is not None and value < last[0] - 1e-9 * abs(last[0]):
                self.u = (self.u + last[1]) / 2                           # the step was too long
                continue
            step = np.clip(np.linalg.solve(S, t[-2] - D * self.u), -4.0, 4.0)
            last = value, self.u
            if np.max(np.abs(step)) < 1e-6:
                break
            self.u = self.u + step
        return t[-1], S

    def hold(self, table):
        return table.cache() if self.q else table

    def release(self, table):
        if self.q:
            table.unpersist()

    def evaluate(self, beta, theta):
        """Laplace log-likelihood and its gradient in (beta, theta)."""
        return answer(self.evaluating(beta, theta), self.table)

    def evaluating(self, beta, theta):
        q, p = self.q, self.p
        table = self.hold((yield beta, False))
        try:
            sums, S = self.modes(table, theta) if q else (None, np.zeros((0, 0)))
            V, D = np.linalg.inv(S) if q else S, self.other_precisions(theta)

            def direct(b, _):
                P, m11, a1, ar, N = b.adjoint(V)
                eb = np.exp(b.o)[:, None] * b.B
                out = {0: np.concatenate((-eb.sum(0) - 0.5 * (P[:, None] * eb).sum(0), [b.u1 @ b.u1, m11.sum()]))}
                if q:
                    out[1] = ar - N.T @ (a1 / b.D1)
                else:
                    s1 = a1 / b.D1
                    out[0] = np.concatenate((out[0], 0.5 * (s1[b.lev][:, None] * eb).sum(0), [s1 @ b.u1],
                                             [b.Sy @ b.o - b.h.sum() - 0.5 * b.d * (b.u1 @ b.u1), np.log(b.D1).sum()]))
                return out

            t = self.totals(table, theta, direct)
            t0 = t.get(0, np.zeros(2 * p + 5))
            if q:
                sr = V @ t[1]

                def through(b, _):
                    _, _, a1, _, N = b.adjoint(V)
                    s1 = (a1 - N @ sr) / b.D1
                    eb = np.exp(b.o)[:, None] * b.B
                    z = s1[b.lev] + sr[b.J].sum(1)
                    return {0: np.concatenate((0.5 * (z[:, None] * eb).sum(0), [s1 @ b.u1]))}

                back = self.totals(table, theta, through)[0]
            else:
                back, sums = t0[p + 2:2 * p + 3], t0[2 * p + 3:]
        finally:
            self.release(table)
        d = self.precision(theta)
        fixed = float(self.Yx @ beta) - self.L
        ll = fixed + sums[0] - 0.5 * float(D @ (self.u * self.u)) - 0.5 * sums[1] - sum(self.q_of[f] * t for f, t in zip(self.random, theta))
        if q:
            ll -= 0.5 * float(np.linalg.slogdet(S)[1])
        g_theta, start = {}, 0
        for f in self.others:
            here = slice(start, start + self.q_of[f])
            start += self.q_of[f]
            u = self.u[here]
            g_theta[f] = d[f] * (u @ u) - self.q_of[f] + d[f] * np.trace(V[here, here]) - d[f] * (sr[here] @ u)
            self.spread[f] = 0.5 * np.log((u @ u + np.trace(V[here, here])) / self.q_of[f])
        f = self.large
        self.spread[f] = 0.5 * np.log((t0[p] + t0[p + 1]) / max(self.q_of[f], 1))
        g_theta[f] = d[f] * t0[p] - self.q_of[f] + d[f] * t0[p + 1] - d[f] * back[p]
        return ll, np.concatenate((self.Yx + t0[:p] + back[:p], [g_theta[f] for f in self.random]))

    def information(self, beta, theta) -> np.ndarray:
        """Information in beta with the random effects eliminated (their modes
        are those of the last evaluation)."""
        return answer(self.informing(beta, theta), self.table)

    def informing(self, beta, theta):
        q, p = self.q, self.p

        def work(b, pdf):
            eo = np.exp(b.o)
            eb = eo[:, None] * b.B
            C = np.concatenate([np.asarray(c, float) for c in pdf["C"]]).reshape(-1, p * p)
            e1 = np.stack([b.by_level(eb[:, j]) for j in range(p)], 1)
            out = {-1: (eo[:, None] * C).sum(0) - (e1.T @ (e1 / b.D1[:, None])).ravel()}
            if q:
                N = b.cross(b.h)
                G = np.stack([b.by_other(eb[:, j]) for j in range(p)], 1) - N.T @ (e1 / b.D1[:, None])
                S = -N.T @ (N / b.D1[:, None])
                for x in range(b.J.shape[1]):
                    for y in range(b.J.shape[1]):
                        np.add.at(S, (b.J[:, x], b.J[:, y]), b.h)
                out.update({i: np.concatenate((G[i], S[i])) for i in range(q)})
            return out

        t = self.totals((yield beta, True), theta, work)
        info = t[-1].reshape(p, p)
        if q:
            rows = np.stack([t[i] for i in range(q)])
            G, S = rows[:, :p], rows[:, p:] + np.diag(self.other_precisions(theta))
            info = info - G.T @ np.linalg.solve(S, G)
        return info

    def mode_tables(self, beta, theta) -> dict:
        """Modes by factor: (level, mode) rows for the large one, a dict for
        each other."""
        k, p, u, d = len(self.others), self.p, self.u, self.precision(theta)[self.large]
        kind = dict(self.frame.dtypes)["__level"]

        def part(batches):
            import pandas as pd
            for pdf in batches:
                yield pd.DataFrame({"level": pdf["__level"], "mode": _Batch(pdf, k, p, u, d).u1})

        out = {f: {lv: float(u[i]) for lv, i in self.levels[f].items()} for f in self.others}
        out[self.large] = self.table(beta).mapInPandas(part, f"level {kind}, mode double")
        return out


class FewCells(Blocks):
    """Blocks from the sums of at most a few thousand cells: tables are pandas
    frames on the driver, each level's cells a list as in ``Blocks.table``.

    ``cells`` has the factors' labels, row count ``n`` and response sum ``Sy``
    by cell; cells that agree in this model's factors become one."""

    def __init__(self, cells, L: float, Yx, feats: list[str], random: list[str], kinds: dict, max_other: int):
        self.feats, self.random, self.p, self.L, self.Yx, self.kinds = feats, random, len(feats), L, np.asarray(Yx, float), kinds
        there = cells["n"].to_numpy() > 0
        known = {f: sorted(set(cells[f][there]), key=str) for f in random}
        self.q_of, self.count = {f: len(x) for f, x in known.items()}, int(cells["n"].sum())
        self.large = max(random, key=lambda f: (self.q_of[f], -random.index(f)))
        self.others = [f for f in random if f != self.large]
        if sum(self.q_of[f] for f in self.others) > max_other:
            raise ValueError(f"the factors beside the largest have more than {max_other} levels in all")
        self.levels, self.q = {}, 0
        for f in self.others:
            self.levels[f] = {lv: self.q + i for i, lv in enumerate(known[f])}
            self.q += len(known[f])
        self.large_levels = known[self.large]
        index = [{lv: i for i, lv in enumerate(self.large_levels)}, *[self.levels[f] for f in self.others]]
        ids = np.stack([np.array([at[lv] for lv in cells[f][there]], int) for f, at in zip([self.large, *self.others], index)], 1)
        own, inverse = np.unique(ids.reshape(-1, len(index)), axis=0, return_inverse=True)
        self.there, self.inverse, self.m, self.J = there, inverse.ravel(), len(own), own[:, 1:]
        self.cuts = np.flatnonzero(np.diff(own[:, 0])) + 1
        self.Sy = self.merge(cells["Sy"].to_numpy(float))
        self.u, self.spread, self.last = np.zeros(self.q), {}, None

    def merge(self, x: np.ndarray) -> np.ndarray:
        """Values of the given cells added up over this model's cells."""
        x = x[self.there].reshape(len(self.inverse), -1)
        return np.stack([np.bincount(self.inverse, c, self.m) for c in x.T], 1)

    def frame_of(self, sums: np.ndarray, second: bool):
        """The table from the given cells' A, B and (``second``) C, a row each."""
        import pandas as pd
        x, p = self.merge(sums), self.p
        parts = {"A": x[:, :1], "Sy": self.Sy, "B": x[:, 1:1 + p], "J": self.J} | ({"C": x[:, 1 + p:]} if second else {})
        levels = len(self.large_levels)
        self.last = pd.DataFrame({c: [a.ravel() for a in np.split(v, self.cuts)] if levels else [] for c, v in parts.items()})
        return self.last

    def hold(self, table):
        return table

    def release(self, table):
        pass

    def totals(self, table, theta, work) -> dict[int, np.ndarray]:
        return _added([table], len(self.others), self.p, self.u, self.precision(theta)[self.large], work)

    def mode_tables(self, beta, theta) -> dict:
        from pyspark.sql import SparkSession
        out = {f: {lv: float(self.u[i]) for lv, i in self.levels[f].items()} for f in self.others}
        u1 = _Batch(self.last, len(self.others), self.p, self.u, self.precision(theta)[self.large]).u1
        rows = [(lv, float(x)) for lv, x in zip(self.large_levels, u1)]
        out[self.large] = SparkSession.getActiveSession().createDataFrame(rows, f"level {self.kinds[self.large]}, mode double")
        return out


def maximise(blocks: Blocks, beta, max_iter: int, tol: float):
    """Quasi-Newton (BFGS) over (beta, theta), as steps that yield (beta, second) for each
    cell table. Returns beta, theta, log-likelihood, iterations and whether it converged."""
    p, k = blocks.p, len(blocks.random)
    at = lambda x: blocks.evaluating(x[:p], x[p:])
    x = np.concatenate((beta, np.full(k, -0.7)))
    ll, g = yield from at(x)
    for _ in range(4):                  # EM steps lead near the standard deviations
        theta = np.clip([blocks.spread[f] for f in blocks.random], LOW, HIGH)
        near = np.max(np.abs(theta - x[p:])) < 0.1
        x = np.concatenate((beta, theta))
        ll, g = yield from at(x)
        if near:
            break
    H = np.zeros((p + k, p + k))
    H[:p, :p] = np.linalg.pinv((yield from blocks.informing(x[:p], x[p:])))
    H[p:, p:] = np.diag([0.5 / max(blocks.q_of[f], 1) for f in blocks.random])
    for it in range(1, max_iter + 1):
        free = np.ones(p + k, bool)
        free[p:] = ~(((x[p:] <= LOW) & (g[p:] < 0)) | ((x[p:] >= HIGH) & (g[p:] > 0)))
        step = np.where(free, H @ np.where(free, g, 0.0), 0.0)
        if g @ step <= 0:
            H = np.diag(np.diag(H).clip(1e-12))
            step = np.where(free, H @ np.where(free, g, 0.0), 0.0)
        step[p:] = np.clip(step[p:], -2.0, 2.0)
        if abs(g @ step) < tol * (abs(ll) + 1) and np.max(np.abs(step)) < 1e-6:
            return x[:p], x[p:], ll, it, True
        t = 1.0
        for _ in range(30):
            new = x + t * step
            new[p:] = np.clip(new[p:], LOW, HIGH)
            ll2, g2 = yield from at(new)
            if np.isfinite(ll2) and ll2 >= ll + 1e-4 * (g @ (new - x)) - 1e-11 * abs(ll):
                break
            t /= 2
        else:
            return x[:p], x[p:], ll, it, False
        s, y = new - x, g - g2
        if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
            r = 1.0 / (s @ y)
            left = np.eye(p + k) - r * np.outer(s, y)
            H = left @ H @ left.T + r * np.outer(s, s)
        done = abs(ll2 - ll) < tol * (abs(ll) + 1) and np.max(np.abs(s)) < 1e-7
        x, ll, g = new, ll2, g2
        if done:
            return x[:p], x[p:], ll, it, True
    return x[:p], x[p:], ll, max_iter, False
