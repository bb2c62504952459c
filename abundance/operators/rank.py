"""Group totals, first-by-minimum, running totals, Akaike weights and sorts
(survey IDs W1-W5, O1).

Windows are used only where the partition is bounded by design: classes
per deployment after a tally, candidate models per response (<= the model
cap). Unbounded groups use aggregates instead (``first_by_min`` is a
``min(struct)`` aggregate, ``group_total`` by ``join`` the aggregate back).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abundance.functions.columns import as_list, col, sorted_cols


def group_total(df: DataFrame, keys: Sequence[str], value: str, out: str = "total",
                bounded: bool = True) -> DataFrame:
    """Attach the group sum of ``value`` to every row (grouped ``mutate``).

    ``bounded=True``: a window, one shuffle; right when each group has few
    rows (e.g. classes of one deployment after a tally). ``bounded=False``:
    partial aggregate joined back, so a hot group never sits in one task.
    """
    keys = as_list(keys)
    if bounded:
        return df.withColumn(out, F.sum(col(value)).over(Window.partitionBy(*keys)))
    from abundance.operators.joins import spread_join
    key = F.to_json(F.struct(*map(col, keys)))                     # never missing, so missing keys are a group too
    tot = df.groupBy(*keys).agg(F.sum(col(value)).alias(out)).select(key.alias("__key"), out)
    return spread_join(df.withColumn("__key", key), tot, "__key", "left").select(*map(col, [c for c in df.columns if c != out]), col(out))


def first_by_min(df: DataFrame, keys: Sequence[str], order_col: str,
                 tie_cols: Sequence[str] = ()) -> DataFrame:
    """``slice(which.min(x))`` per group: the whole row with the smallest
    ``x`` (missing skipped; all-missing groups give no row). Ties go to
    the smallest ``tie_cols`` (R keeps the first row: give the column that
    carries input order). A ``min(struct)`` aggregate: partial-aggregated,
    no sort of the group."""
    keys = as_list(keys)
    rest = [c for c in df.columns if c not in keys and c != order_col and c not in tie_cols]
    s = F.struct(*[col(c) for c in [order_col, *tie_cols, *rest]])
    return (df.where(col(order_col).isNotNull()).groupBy(*keys).agg(F.min(s).alias("__m"))
            .select(*keys, *[F.col(f"__m.{c}").alias(c) for c in [order_col, *tie_cols, *rest]]))


def running_total(df: DataFrame, partition: Sequence[str], order: Sequence[str], value: str,
                  out: str = "cumsum", bounded: bool = True) -> DataFrame:
    """``cumsum(x)`` after ``order()`` within each partition. ``bounded=True``:
    a window, for groups of few rows; ``bounded=False``: ``running_sums``, so
    one group may hold all rows."""
    if not bounded:
        return running_sums(df, partition, sorted_cols(order), {out: value})
    w = (Window.partitionBy(*as_list(partition)).orderBy(*sorted_cols(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.sum(col(value)).over(w))


def delta_to_best(df: DataFrame, partition: Sequence[str], value: str, out: str = "delta",
                  max_delta: float | None = None) -> DataFrame:
    """``x - min(x)`` within the partition; optionally keep ``delta <= max``."""
    res = df.withColumn(out, col(value) - F.min(col(value)).over(Window.partitionBy(*as_list(partition))))
    return res.where(col(out) <= max_delta) if max_delta is not None else res


def akaike_weights(df: DataFrame, partition: Sequence[str], delta: str, out: str = "weight") -> DataFrame:
    """exp(-delta/2) / sum over the partition of exp(-delta/2)."""
    e = F.exp(-col(delta) / 2.0)
    return df.withColumn(out, e / F.sum(e).over(Window.partitionBy(*as_list(partition))))


def sort_table(df: DataFrame, cols: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """``arrange``: missing last."""
    return df.orderBy(*sorted_cols(cols, ascending))


def category_order(df: DataFrame, category: str, value: str, out: str = "order") -> DataFrame:
    """``reorder(category, value)``: the 1-based rank of each category by its
    value, missing values last, ties by category."""
    return global_row_number(df, [col(value).asc_nulls_last(), col(category).asc()], out)


def global_row_number(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """1-based position of every row in one order, without a single-task
    window: rows are range-partitioned (written to the checkpoint folder, so
    that the partitions stay), numbered inside their partition, and moved by
    the counts of the partitions before (one number per partition)."""
    from abundance.session import cut_lineage
    placed = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before, total = [], 0
    for r in sorted(placed.groupBy("__part").count().collect()):
        before.append((r["__part"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "__part int, __before long")            # one row per partition
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (placed.withColumn(out, inside).join(F.broadcast(offsets), "__part")
            .withColumn(out, (col(out) + col("__before")).cast("int")).drop("__part", "__before"))


def running_sums(df: DataFrame, partition: Sequence[str], order: Sequence, sums: dict, parts: int | None = None) -> DataFrame:
    """Add inclusive running sums (``{out: value}``, missing values skipped)
    within each group of ``partition``, in the given order.

    A two-level prefix sum: rows are range-partitioned by (group, order) and
    written to the checkpoint folder, summed inside their range, and moved by
    the group's totals in the ranges before. Only a group that continues from
    the range before has such totals, at most one per range, so the table that
    is broadcast has fewer rows than there are ranges. A group of any size is
    spread over as many ranges as it fills. Rows that tie in ``order`` share a
    range; give a last column that tells them apart if many do.
    """
    return _running(df, partition, order, sums, parts, F.sum, lambda before, here: before + F.coalesce(here, F.lit(0)))


def running_max(df: DataFrame, partition: Sequence[str], order: Sequence, values: dict, parts: int | None = None) -> DataFrame:
    """``running_sums`` with the largest value so far in place of the sum."""
    return _running(df, partition, order, values, parts, F.max, F.greatest)


def _running(df, partition, order, values, parts, fold, join) -> DataFrame:
    from abundance.session import cut_lineage
    keys = as_list(partition)
    ranges = [*map(col, keys), *order]
    placed = df.repartitionByRange(parts, *ranges) if parts else df.repartitionByRange(*ranges)
    placed = cut_lineage(placed.withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = {out: f"__before{i}" for i, out in enumerate(values)}
    pieces = placed.groupBy("__part", *keys).agg(*[fold(col(v)).alias(names[out]) for out, v in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = (pieces.select(F.col("__part").alias("__at"), *[col(k).alias(f"__key{i}") for i, k in enumerate(keys)],
                           F.count("*").over(earlier).alias("__n"), *[fold(b).over(earlier).alias(b) for b in names.values()])
             .where("__n > 0").drop("__n"))                                                  # fewer rows than ranges
    same = F.col("__part") == F.col("__at")
    for i, k in enumerate(keys):
        same &= col(k).eqNullSafe(F.col(f"__key{i}"))
    folded = placed.withColumns({out: fold(col(v)).over(inside) for out, v in values.items()})
    both = folded.join(F.broadcast(carry), same, "left")
    total = {out: F.when(F.col(b).isNull(), col(out)).otherwise(join(F.col(b), col(out))) for out, b in names.items()}
    return both.select(*[col(c) for c in df.columns if c not in values], *[x.alias(out) for out, x in total.items()])
