"""Model formulas -> design columns (R coding rules).

A term list such as ``["depth_m", "site", "depth_m*posidonia"]`` becomes
coefficient names and Column expressions, intercept first. Text columns
are factors: treatment contrasts against the alphabetically first level
(T14), named ``<column><level>`` as R does; ``a*b`` expands to
``a + b + a:b``. Factor levels are the only thing collected (bounded by
the number of categories, size-checked).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundance.operators.joins import distinct_levels

INTERCEPT = "(Intercept)"


@dataclass
class Design:
    names: list[str]
    exprs: list[Column]
    columns: list[str]                 # raw columns used (rows with NULL here drop, T19)
    levels: dict[str, list] = field(default_factory=dict)

    @property
    def p(self) -> int:
        return len(self.names)


def expand_terms(terms: Sequence[str]) -> list[tuple[str, ...]]:
    """``a*b`` -> (a,), (b,), (a, b); ``a:b`` -> (a, b); keeps first order."""
    out: list[tuple[str, ...]] = []
    for t in terms:
        t = t.replace(" ", "")
        if "*" in t:
            parts = t.split("*")
            from itertools import combinations
            for r in range(1, len(parts) + 1):
                for combo in combinations(parts, r):
                    if combo not in out:
                        out.append(combo)
        else:
            combo = tuple(t.split(":"))
            if combo not in out:
                out.append(combo)
    out.sort(key=len)          # main effects before interactions, as R orders them
    return out


def design_columns(terms: Sequence[str]) -> list[str]:
    """Raw columns a term list uses, in first-use order."""
    out: list[str] = []
    for combo in expand_terms(terms):
        for c in combo:
            if c not in out:
                out.append(c)
    return out


def model_input(df: DataFrame, columns: Sequence[str], checkpoint: bool = False) -> DataFrame:
    """The model's raw columns, projected and kept once: factor levels,
    knots and every fitting pass then read them instead of re-running the
    upstream plan. The input keeps its partitions.

    ``checkpoint=False``: cached; blocks lost with an executor are
    recomputed from lineage (the whole upstream plan). ``checkpoint=True``:
    written to the cluster's shared ``spark.checkpoint.dir`` (reliable
    checkpoint), so a lost executor costs a re-read, which suits long fits
    (GLMM, full subsets) over expensive inputs."""
    seen: list[str] = []
    for c in columns:
        if c and c not in seen:
            seen.append(c)
    proj = df.select(*seen)
    if checkpoint:
        from abundance.session import cut_lineage
        return cut_lineage(proj)
    return proj.cache()


def build_design(df: DataFrame, terms: Sequence[str], intercept: bool = True,
                 levels: dict[str, list] | None = None, max_levels: int = 10_000) -> Design:
    levels = dict(levels or {})
    types = dict(df.dtypes)
    combos = expand_terms(terms)
    raw = sorted({c for combo in combos for c in combo}, key=lambda c: [x for t in combos for x in t].index(c))
    for c in raw:
        if types[c] == "string" and c not in levels:
            levels[c] = [t[0] for t in distinct_levels(df.where(F.col(c).isNotNull()), [c], max_levels)]
    names: list[str] = [INTERCEPT] if intercept else []
    exprs: list[Column] = [F.lit(1.0)] if intercept else []

    def pieces(c: str) -> list[tuple[str, Column]]:
        if c in levels:
            return [(f"{c}{lv}", F.when(F.col(c) == F.lit(lv), F.lit(1.0)).otherwise(F.lit(0.0)))
                    for lv in levels[c][1:]]
        return [(c, F.col(c).cast("double"))]

    for combo in combos:
        acc = [("", None)]
        for c in combo:
            acc = [((n + ":" if n else "") + pn, pe if e is None else e * pe)
                   for n, e in acc for pn, pe in pieces(c)]
        for n, e in acc:
            names.append(n)
            exprs.append(e)
    return Design(names, exprs, raw, levels)
