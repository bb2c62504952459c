"""Natural joins, anti joins and zero filling (survey IDs J1-J5).

R joins without ``by=`` use every shared column as a key and match NA to
NA (trap T4). Here the shared list is computed and logged, an explicit
``on`` is accepted, and keys compare with ``<=>`` (plain ``=`` when either
side's keys are non-nullable, where both give the same rows). Spark plans
``<=>`` as an equi-join (hash / sort-merge, never nested loop) on
(coalesce(k), isnull(k)); AQE picks broadcast from measured sizes and
splits skewed partitions, but not where a side is an aggregate on the key:
``spread_join`` is for rows of hot keys that meet such a table.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundance.functions.columns import as_list

log = logging.getLogger(__name__)

_L, _R = "__l", "__r"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lc(k: str) -> Column:
    return F.col(f"{_L}.{_q(k)}")


def _rc(k: str) -> Column:
    return F.col(f"{_R}.{_q(k)}")


def shared_keys(left: DataFrame, right: DataFrame) -> list[str]:
    rset = set(right.columns)
    return [c for c in left.columns if c in rset]


def _keys(left: DataFrame, right: DataFrame, on) -> list[str]:
    keys = as_list(on) if on is not None else shared_keys(left, right)
    if not keys:
        raise ValueError("natural join: no shared columns and no `on` given")
    if on is None:
        log.info("natural join by %s", keys)
    return keys


def _condition(keys: Sequence[str], null_safe: bool) -> Column:
    parts = [(_lc(k).eqNullSafe(_rc(k)) if null_safe else (_lc(k) == _rc(k))) for k in keys]
    return reduce(lambda a, b: a & b, parts)


def _na_rule(null_safe: bool, na_matches: str | None) -> bool:
    """dplyr's ``na_matches``: ``"na"`` (R default, missing keys match
    missing keys) or ``"never"`` (SQL equality: a plain equi-join that keeps
    an existing hash partitioning on the keys usable)."""
    if na_matches is None:
        return null_safe
    if na_matches not in ("na", "never"):
        raise ValueError("na_matches must be 'na' or 'never'")
    return na_matches == "na"


def _needs_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> bool:
    """``<=>`` differs from ``=`` only when both sides can hold a missing key;
    if either side declares its keys non-nullable, plain equality is exact
    (and keeps an existing hash partitioning on the keys usable)."""
    def nullable(df):
        f = {x.name: x.nullable for x in df.schema.fields}
        return any(f.get(k, True) for k in keys)
    return nullable(left) and nullable(right)


def natural_join(left: DataFrame, right: DataFrame, how: str = "left", on=None,
                 null_safe: bool = True, suffixes: tuple[str, str] = ("_x", "_y"),
                 na_matches: str | None = None) -> DataFrame:
    """dplyr ``left_join`` / ``right_join`` / ``inner_join`` / ``full_join``.

    Keys come out once: from the left for left/inner joins, from the right
    for right joins, coalesced for full joins. Non-key columns present on
    both sides (only possible with an explicit ``on``) get ``suffixes``.
    Missing keys match missing keys (R rule) when ``null_safe``; Spark plans
    that as an equi-join on (coalesce(k), isnull(k)), which re-shuffles a
    side already partitioned by k. Pass ``null_safe=False`` when keys are
    known to be present to keep that partitioning.
    """
    keys = _keys(left, right, on)
    how = {"outer": "full", "full_outer": "full"}.get(how, how)
    null_safe = _na_rule(null_safe, na_matches)
    ns = null_safe and _needs_null_safe(left, right, keys)
    joined = left.alias(_L).join(right.alias(_R), _condition(keys, ns), how)
    if how == "right":
        key_cols = [_rc(k).alias(k) for k in keys]
    elif how == "full":
        key_cols = [F.coalesce(_lc(k), _rc(k)).alias(k) for k in keys]
    else:
        key_cols = [_lc(k).alias(k) for k in keys]
    kset = set(keys)
    lrest = [c for c in left.columns if c not in kset]
    rrest = [c for c in right.columns if c not in kset]
    clash = set(lrest) & set(rrest)
    cols = key_cols
    cols += [_lc(c).alias(c + suffixes[0] if c in clash else c) for c in lrest]
    cols += [_rc(c).alias(c + suffixes[1] if c in clash else c) for c in rrest]
    return joined.select(*cols)


def anti_join(left: DataFrame, right: DataFrame, on=None, null_safe: bool = True,
              na_matches: str | None = None) -> DataFrame:
    """Rows of ``left`` with no match in ``right`` (dplyr ``anti_join``)."""
    keys = _keys(left, right, on)
    ns = _na_rule(null_safe, na_matches) and _needs_null_safe(left, right, keys)
    return left.alias(_L).join(right.alias(_R), _condition(keys, ns), "left_anti")


def semi_join(left: DataFrame, right: DataFrame, on=None, null_safe: bool = True) -> DataFrame:
    keys = _keys(left, right, on)
    ns = null_safe and _needs_null_safe(left, right, keys)
    return left.alias(_L).join(right.alias(_R), _condition(keys, ns), "left_semi")


def spread_join(rows: DataFrame, table: DataFrame, on, how: str = "left", counts: DataFrame | None = None,
                share: int = 10_000, salts: int | None = None) -> DataFrame:
    """Join ``rows`` to a table with one row per key where a few keys may hold
    most of the rows (left, inner, left_semi or left_anti; missing keys match
    nothing).

    A key with more than 1 / ``share`` of all rows is hot, so at most ``share``
    keys are, whatever the size: these are broadcast to both sides, their rows
    get one of ``salts`` numbers in turn and their table row is repeated once a
    number. Rows with a missing key are dealt out likewise. All other keys join
    as usual, so no task gets a hot key whole, with or without adaptive
    execution. ``counts`` (keys and ``__n``) saves counting the rows.
    """
    keys = as_list(on)
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    total = counts.agg(F.sum("__n")).first()[0] or 0
    hot = counts.where(F.col("__n") * share > total).dropna(subset=keys).select(*keys, F.lit(True).alias("__hot"))   # < share rows
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    missing = reduce(lambda a, b: a | b, [F.col(_q(k)).isNull() for k in keys])
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.when(F.col("__hot") | missing, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(0))
    repeated = table.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.drop("__hot").join(repeated.drop("__hot"), [*keys, "__salt"], how).drop("__salt")


def mismatch_report(a: DataFrame, b: DataFrame, on=None, names: tuple[str, str] = ("left", "right"),
                    side_col: str = "side") -> DataFrame:
    """Two-way anti join as one table: keys of rows found on one side only.

    ``side`` says which table holds the row (``<left>_only``/``<right>_only``);
    a key appears once per row of its table, as ``anti_join`` returns rows.
    Both key lists are stacked and grouped once (partial aggregation, one
    shuffle) instead of two anti joins; grouping puts missing keys in one
    group, R's NA-matches-NA rule.
    """
    keys = _keys(a, b, on)
    stacked = (a.select(*keys, F.lit(1).alias("__a"), F.lit(0).alias("__b"))
               .unionByName(b.select(*keys, F.lit(0).alias("__a"), F.lit(1).alias("__b"))))
    per_key = stacked.groupBy(*keys).agg(F.sum("__a").alias("__na"), F.sum("__b").alias("__nb"))
    side = (F.when(F.col("__nb") == 0, F.lit(f"{names[0]}_only"))
            .when(F.col("__na") == 0, F.lit(f"{names[1]}_only")))
    n = F.when(F.col("__nb") == 0, F.col("__na")).otherwise(F.col("__nb")).cast("int")
    one_sided = per_key.where((F.col("__na") == 0) | (F.col("__nb") == 0))
    return (one_sided.select(*keys, side.alias(side_col), F.explode(F.array_repeat(F.lit(1), n)).alias("__r"))
            .drop("__r"))


def zero_fill(obs: DataFrame, roster: DataFrame, keys: Sequence[str], values: Sequence[str],
              fill=0) -> DataFrame:
    """``obs %>% right_join(roster) %>% mutate(v = if_else(is.na(v), 0, v))``.

    Every roster row is kept; a deployment without observations gets
    ``fill`` (true zero, trap T11). ``obs`` should already be at roster
    grain (one row per key), so the join is one-to-one per key.
    """
    joined = natural_join(obs, roster, how="right", on=keys)
    return joined.withColumns({v: F.coalesce(F.col(v), F.lit(fill)) for v in as_list(values)})


def distinct_levels(df: DataFrame, cols: Sequence[str], max_levels: int = 100_000) -> list[tuple]:
    """Distinct value tuples of a categorical key, collected under a size check.

    Used for pivot headers and the taxon grid; raises instead of pulling an
    unbounded list to the driver.
    """
    rows = df.select(*cols).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"{cols}: more than {max_levels} levels; pass them explicitly")
    return sorted((tuple(r) for r in rows), key=lambda t: tuple((v is None, v) for v in t))


def zero_fill_grid(obs: DataFrame, roster: DataFrame, sample_keys: Sequence[str],
                   taxon_cols: Sequence[str], values: Sequence[str], fill=0,
                   levels: Sequence[tuple] | None = None, block: int = 1000) -> DataFrame:
    """True zeros for every taxon in every deployment (bulk form of J4).

    ``levels`` is the taxon list; without it the distinct taxa of ``obs``,
    which stay a distributed table. The result has deployments x taxa rows by
    definition. It is made in cells of about ``block`` deployments by ``block``
    taxa: roster rows get a row chunk and are repeated once per taxon block,
    taxa get a block and are repeated once per row chunk, and the two meet in
    an equi-join on (chunk, block). So no task makes more than some cells,
    either table may be of any size, and what is moved is a thousandth of the
    result. The observations are then left-joined on (sample keys, taxon), a
    fine-grained key, so one busy deployment spreads over many keys.
    """
    from abundance.session import cut_lineage
    sample_keys, taxon_cols, values = as_list(sample_keys), as_list(taxon_cols), as_list(values)
    obs = obs.select(*sample_keys, *taxon_cols, *values)
    if levels is None:
        obs = cut_lineage(obs)                                   # read twice: for its taxa and for its values
        taxa = obs.select(*taxon_cols).distinct()
    else:
        schema = ", ".join(f"{_q(c)} {dict(obs.dtypes)[c]}" for c in taxon_cols)
        taxa = obs.sparkSession.createDataFrame([tuple(lv) for lv in levels], schema)
    chunks, blocks = max(1, -(-roster.count() // block)), max(1, -(-taxa.count() // block))
    one_of = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = roster.withColumn("__chunk", one_of(chunks)).withColumn("__block", every(blocks))
    columns = taxa.withColumn("__block", one_of(blocks)).withColumn("__chunk", every(chunks))
    grid = rows.join(columns, ["__chunk", "__block"]).drop("__chunk", "__block")
    joined = natural_join(grid, obs, how="left", on=sample_keys + taxon_cols)
    return joined.withColumns({v: F.coalesce(F.col(v), F.lit(fill)) for v in values})
