"""DuckDB SQL for the model queries: generalised linear models by iteratively
reweighted least squares, unrolled into common table expressions.

``glm_ctes`` writes one chain: the design rows, then per step the sums
X'WX and X'Wz (by group where there is one) and their solution by
Gauss-Jordan elimination, one expression per pivot. The last step also
carries the inverse and the log-likelihood.
"""

from __future__ import annotations


# family: (start of the linear predictor, weight, weight x working response,
# log-likelihood, variance), in terms of y and e, the linear predictor.
FAMILIES = {
    "poisson": ("ln(y + 0.1)", "exp(e)", "exp(e) * e + y - exp(e)", "y * e - exp(e) - lgamma(y + 1)", "exp(e)"),
    "binomial": ("ln((y + 0.5) / (1.5 - y))", "1 / (2 + exp(e) + exp(-e))", "e / (2 + exp(e) + exp(-e)) + y - 1 / (1 + exp(-e))",
                 "y * e - ln(1 + exp(e))", "1 / (2 + exp(e) + exp(-e))"),
    "tweedie:1.5": ("ln(y + 0.1)", "exp(e / 2)", "exp(e / 2) * e + (y - exp(e)) * exp(-e / 2)", "0.0", "exp(1.5 * e)"),
}


def glm_ctes(name: str, src: str, y: str, xs: list[str], group: str | None = None, steps: int = 9, family: str = "poisson",
             penalty: dict | None = None) -> list[tuple[str, str]]:
    """CTEs (name, sql); the last is ``<name>_fit``: g, n, ll, pear (sum of
    squared Pearson residuals), b0.., s0.. (the coefficients and their standard
    errors at dispersion one) and v0_0.. (the inverse information). ``penalty``
    adds constants to cells (i, j) of X'WX."""
    begin, weight, working, loglik, variance = FAMILIES[family]
    p = len(xs)
    R = range(p)
    present = " AND ".join(f"({e}) IS NOT NULL" for e in [y, *xs] + ([group] if group else []))
    cols = ", ".join([f"CAST({y} AS DOUBLE) AS y", *[f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(xs)]])
    out = [(f"{name}_d", f"SELECT {group or '1'} AS g, {cols} FROM ({src}) WHERE {present}")]
    solved = None
    for k in range(steps + 1):
        last = k == steps
        if solved is None:
            frm = f"(SELECT *, {begin} AS e FROM {name}_d)"
        else:
            eta = " + ".join(f"b{i} * x{i}" for i in R)
            frm = f"(SELECT d.*, {eta} AS e FROM {name}_d d JOIN {solved} b ON d.g = b.g)"
        sums = [f"sum(({weight}) * x{i} * x{j}) + {float((penalty or {}).get((i, j), 0.0))!r} AS m{i}_{j}" for i in R for j in R]
        sums += [f"sum(({working}) * x{i}) AS r{i}" for i in R]
        ident = [f"{float(i == j)} AS v{i}_{j}" for i in R for j in R] if last else []
        extra = ["count(*) AS n", f"sum({loglik}) AS ll", f"sum((y - exp(e)) * (y - exp(e)) / ({variance})) AS pear"] if last else []
        out.append((f"{name}_s{k}", f"SELECT g, {', '.join(sums + extra + ident)} FROM {frm} GROUP BY g"))
        right = ["r{i}"] + (["v{i}_" + str(j) for j in R] if last else [])
        prev = eliminate(out, f"{name}_s{k}", p, right, ["n", "ll", "pear"] if last else [])
        if last:
            out.append((f"{name}_fit", "SELECT f.g, f.n, f.ll, f.pear, " + ", ".join([f"b.b{i}" for i in R] + [f"sqrt(f.v{i}_{i}) AS s{i}" for i in R]
                                                                             + [f"f.v{i}_{j}" for i in R for j in R])
                        + f" FROM {prev} f JOIN {solved} b ON f.g = b.g"))
        else:
            solved = f"{name}_b{k}"
            out.append((solved, f"SELECT g, {', '.join(f'r{i} AS b{i}' for i in R)} FROM {prev}"))
    return out


def eliminate(out: list, prev: str, p: int, right: list[str], carried: list[str]) -> str:
    """Append one CTE per pivot that turns m (p x p) into the identity and the
    right-hand columns into the solutions; returns the last name."""
    first = prev
    for t in range(p):
        sel = []
        for i in range(p):
            cells = [f"m{i}_{j}" for j in range(p)] + [c.format(i=i) for c in right]
            tops = [f"m{t}_{j}" for j in range(p)] + [c.format(i=t) for c in right]
            for c, top in zip(cells, tops):
                sel.append(f"{top} / m{t}_{t} AS {c}" if i == t else f"{c} - m{i}_{t} * {top} / m{t}_{t} AS {c}")
        out.append((f"{first}p{t}", f"SELECT {', '.join(['g', *sel, *carried])} FROM {prev}"))
        prev = f"{first}p{t}"
    return prev


def zip_ctes(name: str, src: str, y: str, xs: list[str], steps: int = 8) -> list[tuple[str, str]]:
    """Zero-inflated Poisson with the same columns in both parts: Newton steps
    on the full likelihood from the two separate fits. The last CTE is
    ``<name>_fit``: n, ll, b0.. and s0.., count part first. With e the count
    predictor, f the zero predictor, u = exp(e) and q the posterior weight of
    the zero part, the derivatives of a row are closed forms."""
    p = len(xs)
    R, P = range(p), range(2 * p)
    out = glm_ctes(f"{name}c", src, y, xs)
    out += glm_ctes(f"{name}z", src, f"CASE WHEN {y} = 0 THEN 1 ELSE 0 END", xs, family="binomial")
    solved = f"{name}_t0"
    out.append((solved, "SELECT 1 AS g, " + ", ".join([f"c.b{i} AS b{i}" for i in R] + [f"z.b{i} AS b{i + p}" for i in R]) + f" FROM {name}c_fit c, {name}z_fit z"))
    for k in range(1, steps + 2):
        last = k == steps + 1
        eta = " + ".join(f"b{i} * x{i}" for i in R)
        zeta = " + ".join(f"b{i + p} * x{i}" for i in R)
        rows = f"SELECT d.*, {eta} AS e, {zeta} AS f FROM {name}c_d d, {solved}"
        rows = f"SELECT *, exp(e) AS u, 1 / (1 + exp(-f)) AS s, CASE WHEN y = 0 THEN 1 / (1 + exp(-(f + exp(e)))) ELSE 0.0 END AS q FROM ({rows})"
        ge, gf = "CASE WHEN y = 0 THEN -(1 - q) * u ELSE y - u END", "q - s"
        hee = "CASE WHEN y = 0 THEN q * (1 - q) * u * u - (1 - q) * u ELSE -u END"
        hff, hef = "q * (1 - q) - s * (1 - s)", "q * (1 - q) * u"
        ll = "CASE WHEN y = 0 THEN f + ln(1 + exp(-(f + u))) ELSE y * e - u - lgamma(y + 1) END - (f + ln(1 + exp(-f)))"
        out.append((f"{name}_w{k}", f"SELECT *, {ge} AS ge, {gf} AS gf, {hee} AS hee, {hff} AS hff, {hef} AS hef, {ll} AS l FROM ({rows})"))
        h = lambda i, j: "hee" if i < p and j < p else "hff" if i >= p and j >= p else "hef"
        sums = [f"-sum({h(i, j)} * x{i % p} * x{j % p}) AS m{i}_{j}" for i in P for j in P] + [f"sum({'ge' if i < p else 'gf'} * x{i % p}) AS r{i}" for i in P]
        ident = [f"{float(i == j)} AS v{i}_{j}" for i in P for j in P] if last else []
        extra = ["count(*) AS n", "sum(l) AS ll"] if last else []
        out.append((f"{name}_h{k}", f"SELECT 1 AS g, {', '.join(sums + extra + ident)} FROM {name}_w{k}"))
        prev = eliminate(out, f"{name}_h{k}", 2 * p, ["r{i}"] + (["v{i}_" + str(j) for j in P] if last else []), ["n", "ll"] if last else [])
        if last:
            out.append((f"{name}_fit", "SELECT f.n, f.ll, " + ", ".join([f"t.b{i}" for i in P] + [f"sqrt(f.v{i}_{i}) AS s{i}" for i in P]) + f" FROM {prev} f, {solved} t"))
        else:
            out.append((f"{name}_t{k}", f"SELECT 1 AS g, {', '.join(f't.b{i} + f.r{i} AS b{i}' for i in P)} FROM {prev} f, {solved} t"))
            solved = f"{name}_t{k}"
    return out


def normal_p(z: str) -> str:
    """Two-sided normal tail of a z value, by the rational approximation of
    Abramowitz and Stegun 7.1.26 (error below 2e-7)."""
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    poly = f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429))))"
    return f"({poly}) * exp(-({z}) * ({z}) / 2)"


def coef_rows(name: str, model: str, terms: list[str], digits: int = 4) -> str:
    """SELECT of the coefficient table: model, term, estimate, se, z, p, n,
    aic and df."""
    rows = []
    for i, t in enumerate(terms):
        z = f"b{i} / s{i}"
        rows.append(f"SELECT {model} AS model, '{t}' AS term, ROUND(b{i}, {digits}) + 0.0 AS estimate, ROUND(s{i}, {digits}) AS se, "
                    f"ROUND({z}, {digits}) + 0.0 AS z, ROUND({normal_p(z)}, {digits}) AS p, n, -2 * ll + 2 * {len(terms)} AS aic, "
                    f"{len(terms)} AS df FROM {name}_fit")
    return " UNION ALL ".join(rows)
