"""Projection, cleaning and filter operators (survey IDs P1-P19).

Each is a narrow transformation: no shuffle, pushed down by Catalyst where
it is a filter or a projection.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.functions.columns import (
    all_of, as_list, col, drop_predicate, keep_predicate, local_date, local_time, safe_ratio, to_number,
)


# ---------------------------------------------------------------- P1 names

def snake_case(name: str) -> str:
    """One name to snake case: ``Video location`` -> ``video_location``,
    ``mean.relief`` -> ``mean_relief``, ``latitudeDD`` -> ``latitude_dd``."""
    s = name.replace("%", "_percent_").replace("#", "_number_")
    s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", s)
    s = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", s)
    s = re.sub(r"[^0-9A-Za-z]+", "_", s).strip("_").lower()
    if not s:
        s = "x"
    if s[0].isdigit():
        s = "x" + s
    return s


def clean_names(df: DataFrame) -> DataFrame:
    """Unique snake-case column names; clashes get ``_2``, ``_3`` ...."""
    seen: dict[str, int] = {}
    out = []
    for n in df.columns:
        base = snake_case(n)
        k = seen.get(base, 0) + 1
        seen[base] = k
        out.append(base if k == 1 else f"{base}_{k}")
    return df.toDF(*out)


# ------------------------------------------------------- P2-P4 projections

def select_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def drop_cols(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """``rename(new = old)``; given here as {old: new}."""
    return df.withColumnsRenamed(mapping)


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


# ---------------------------------------------------- P5-P7 derived values

def relabel(df: DataFrame, rules: Sequence[tuple[str, object, dict]]) -> DataFrame:
    """Conditional relabel, one ``if_else(cond, new, x)`` per rule.

    ``rules`` = [(target_column, new_value, {column: values, ...}), ...].
    Rules apply in order; a later rule sees the earlier result, as a chain
    of ``mutate`` calls does.
    """
    for target, new_value, cond in rules:
        df = df.withColumn(target, F.when(all_of(cond), F.lit(new_value)).otherwise(col(target)))
    return df


def classify(df: DataFrame, rules: Sequence[tuple[dict, object]], out: str) -> DataFrame:
    """``case_when`` with no default: unmatched rows get NULL.

    ``rules`` = [({column: values, ...}, label), ...], first match wins.
    """
    expr = None
    for cond, label in rules:
        c = all_of(cond)
        expr = F.when(c, F.lit(label)) if expr is None else expr.when(c, F.lit(label))
    return df.withColumn(out, expr if expr is not None else F.lit(None).cast("string"))


def with_taxon_label(df: DataFrame, parts: Sequence[str], out: str = "scientific",
                     sep: str = " ") -> DataFrame:
    from abundance.functions.columns import taxon_label
    return df.withColumn(out, taxon_label(*parts, sep=sep))


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``as.numeric`` on text columns; bad text -> NULL."""
    return df.withColumns({c: to_number(c) for c in as_list(cols)})


def split_local_datetime(df: DataFrame, col_name: str = "date_time",
                         date_out: str = "date", time_out: str = "time") -> DataFrame:
    """Local date and time from ISO text with offset, by position."""
    return df.withColumns({date_out: local_date(col_name), time_out: local_time(col_name)})


def as_percent(df: DataFrame, num: str, den: str, out: str) -> DataFrame:
    return df.withColumn(out, safe_ratio(num, den, 100.0))


def as_proportion(df: DataFrame, cols: Sequence[str], den: str) -> DataFrame:
    return df.withColumns({c: safe_ratio(c, den) for c in as_list(cols)})


def fill_missing(df: DataFrame, cols: Sequence[str], value=0) -> DataFrame:
    """``if_else(is.na(x), 0, x)`` after a join."""
    return df.withColumns({c: F.coalesce(col(c), F.lit(value)) for c in as_list(cols)})


# ------------------------------------------------------------ P13-P17 rows

def keep_in(df: DataFrame, column: str, values) -> DataFrame:
    """``filter(x %in% values)``: missing never kept unless NA is listed."""
    return df.filter(keep_predicate(column, as_list(values) if not isinstance(values, str) else [values]))


def exclude_values(df: DataFrame, column: str, values) -> DataFrame:
    """``filter(!x %in% values)`` with R meaning when NA is listed."""
    return df.filter(drop_predicate(column, values))


def exclude_value(df: DataFrame, column: str, value) -> DataFrame:
    """``filter(!x == v)``: missing x is dropped too, as in R."""
    return df.filter(col(column) != F.lit(value))


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=as_list(cols))


def strictly_above(df: DataFrame, column: str, bound) -> DataFrame:
    """``x > bound``; bound is a number or another column name."""
    b = col(bound) if isinstance(bound, str) else F.lit(bound)
    return df.filter(col(column) > b)


def strictly_below(df: DataFrame, column: str, bound) -> DataFrame:
    b = col(bound) if isinstance(bound, str) else F.lit(bound)
    return df.filter(col(column) < b)


# ----------------------------------------------------------- P9 categories

def factor_levels(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """``as.factor``: add the 1-based alphabetic level index of ``column``.

    A distributed dense rank: the distinct values (counted, so combined
    before their shuffle) are numbered in range partitions
    (``rank.global_row_number``) and joined back with the rows of very
    frequent categories dealt out (``joins.spread_join``). Any number of
    levels; no category is moved into one task. Missing stays missing.
    """
    from abundance.operators.joins import spread_join
    from abundance.operators.rank import global_row_number
    from abundance.session import cut_lineage
    out = out or f"{column}_level"
    counts = cut_lineage(df.groupBy(col(column)).agg(F.count("*").alias("__n")))
    levels = global_row_number(counts.where(col(column).isNotNull()).select(col(column)), [col(column).asc()], out)
    return spread_join(df, levels, [column], "left", counts=counts)


# --------------------------------------------------------- P18-P19 spatial

def with_point(df: DataFrame, lon: str, lat: str, out: str = "geometry",
               crs: int = 4326) -> DataFrame:
    """``st_as_sf(coords, crs, remove=FALSE)``: keeps lon/lat columns."""
    return df.withColumns({
        out: F.struct(col(lon).cast("double").alias("lon"), col(lat).cast("double").alias("lat")),
        f"{out}_crs": F.lit(crs),
    })


def within_bbox(df: DataFrame, lon: str, lat: str, xlim: Sequence[float],
                ylim: Sequence[float]) -> DataFrame:
    """Rows inside a map extent; limits may be given high-to-low."""
    x0, x1 = sorted(xlim)
    y0, y1 = sorted(ylim)
    return df.filter(col(lon).between(x0, x1) & col(lat).between(y0, y1))
