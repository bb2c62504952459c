"""Stacking and pivots (survey IDs U1, U2, R1, R2)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.functions.columns import as_list, col


def stack_tables(*dfs: DataFrame) -> DataFrame:
    """``bind_rows``: stack by column name, missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def stack_named(tables: dict[str, DataFrame], names_to: str = "name") -> DataFrame:
    """``list_rbind(names_to=)``: stack a named list, name as a column."""
    return stack_tables(*[df.withColumn(names_to, F.lit(k)) for k, df in tables.items()])


def widen(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str, fill=0,
          levels: Sequence | None = None, null_name: str = "unclassified",
          name_fn=None, combine=None) -> DataFrame:
    """``pivot_wider(values_fill=fill)``.

    Only absent cells are filled; a present cell holding NULL stays NULL
    (T9). A NULL class becomes the column ``null_name`` (T8). Give
    ``levels`` to skip Spark's distinct pass over ``names_from`` (else it
    is collected, capped by ``spark.sql.pivotMaxValues``).

    Two rows for one cell are an error when the rows are computed, unless
    ``combine`` (a function of a Column name, e.g. ``F.sum``) says how to
    join them.
    """
    ids = as_list(ids)
    name_col = F.coalesce(col(names_from).cast("string"), F.lit(null_name))
    data = df.select(*ids, name_col.alias("__name"), col(values_from).alias("__v"))
    if levels is not None:
        levels = [null_name if v is None else str(v) for v in levels]
    g = data.groupBy(*ids)
    piv = (g.pivot("__name", levels) if levels is not None else g.pivot("__name"))
    wide = piv.agg((combine or F.first)("__v").alias("v"), F.count(F.lit(1)).alias("n"))
    lvls = [c[: -len("_v")] for c in wide.columns if c.endswith("_v") and c not in ids]
    out = [col(c) for c in ids]
    for lv in lvls:
        v, n = f"`{lv}_v`", f"`{lv}_n`"
        cell = F.when(F.coalesce(F.col(n), F.lit(0)) == 0, F.lit(fill)).otherwise(F.col(v))
        if combine is None:
            cell = F.when(F.col(n) > 1, F.raise_error(F.lit(f"more than one value for a cell of {lv}; pass combine"))).otherwise(cell)
        out.append(cell.alias(name_fn(lv) if name_fn else lv))
    return wide.select(*out)


def lengthen(df: DataFrame, ids: Sequence[str] | None = None, cols: Sequence[str] | None = None,
             names_to: str = "name", values_to: str = "value", cast: str | None = None) -> DataFrame:
    """``pivot_longer``: give ``cols`` or ``ids`` (the ``-c(ids)`` form).
    NULL values are kept. Mixed types are cast to ``cast`` (default: the
    first column's type)."""
    if cols is None:
        ids = as_list(ids)
        cols = [c for c in df.columns if c not in ids]
    if ids is None:
        ids = [c for c in df.columns if c not in cols]
    cols = list(cols)
    types = dict(df.dtypes)
    t = cast or types[cols[0]]
    if any(types[c] != t for c in cols):
        df = df.withColumns({c: col(c).cast(t) for c in cols})
    return df.unpivot(list(ids), cols, names_to, values_to)
