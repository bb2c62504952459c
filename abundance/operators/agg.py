"""Aggregations (survey IDs A1-A22).

All are ``groupBy().agg()`` with algebraic aggregates, so Spark runs a
partial (map-side) aggregate before the shuffle: a deployment or taxon
holding a third of the rows is pre-reduced in every task and never lands
whole in one task. The only non-algebraic aggregate is the exact
percentile of ``describe_num`` (buffer = distinct values); ``approx=True``
switches it to a fixed-size sketch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.functions.columns import (
    as_list, col, count_if, na_corr, na_max, na_mean, na_sd, na_sum,
)


# ------------------------------------------------------------- A1-A3 counts

def max_n(df: DataFrame, keys: Sequence[str], count: str = "count", na_rm: bool = False,
          out: str | None = None) -> DataFrame:
    """MaxN: the maximum count of a taxon seen at once in a deployment.

    ``na_rm=False`` is R's ``max``: one missing count makes MaxN missing.
    """
    return df.groupBy(*keys).agg(na_max(count, na_rm).alias(out or count))


def sum_counts(df: DataFrame, keys: Sequence[str], count: str = "count", na_rm: bool = False,
               out: str | None = None) -> DataFrame:
    """Sum of MaxN over stages / sexes per taxon (``summarise(sum(count))``)."""
    return df.groupBy(*keys).agg(na_sum(count, na_rm).alias(out or count))


def top_species(df: DataFrame, taxon: str = "scientific", count: str = "count",
                out: str = "sum_maxn", n: int | None = None, ascending: bool = True,
                na_rm: bool = False) -> DataFrame:
    """Overall abundance (sum of MaxN) per taxon, sorted; ``n`` keeps the top n.

    The limit is the feature here (a top-k report); Spark plans
    ``orderBy().limit()`` as a distributed top-k.
    """
    agg = df.groupBy(taxon).agg(na_sum(count, na_rm).alias(out))
    order = [col(out).asc_nulls_last() if ascending else col(out).desc_nulls_last(), col(taxon).asc()]
    res = agg.orderBy(*order)
    return res.limit(n) if n else res


# ------------------------------------------------------- A4-A5 habitat tally

def weighted_tally(df: DataFrame, keys: Sequence[str], weight: str, out: str = "n") -> DataFrame:
    """dplyr ``tally(wt)``: sum of weights, missing weights skipped, 0 if none."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(weight), F.lit(0)).alias(out))


def point_count(df: DataFrame, keys: Sequence[str], out: str = "number") -> DataFrame:
    """Unit weight then sum = number of annotated points per class."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


# ---------------------------------------------------------- A6-A8 relief

def uncount(df: DataFrame, weight: str, keep: bool = False) -> DataFrame:
    """tidyr ``uncount``: repeat each row ``weight`` times; weight 0 drops
    the row (T12). Prefer ``weighted_moments`` for statistics."""
    out = df.withColumn("__rep", F.explode(F.array_repeat(F.lit(1), col(weight).cast("int"))))
    out = out.drop("__rep")
    return out if keep else out.drop(weight)


def weighted_moments(df: DataFrame, keys: Sequence[str], x: str, weight: str,
                     mean_out: str = "mean", sd_out: str = "sd", na_rm_mean: bool = False) -> DataFrame:
    """Mean and sd of ``x`` replicated by ``weight``, without replicating.

    Equal to ``uncount(weight)`` then ``mean(x)`` and ``sd(x, na.rm=TRUE)``:
    rows of weight <= 0 or missing weight drop out; with ``na_rm_mean=False``
    a missing ``x`` (of positive weight) makes the mean missing; the sd is
    NULL when the total weight of present values is <= 1.

    One scan and no join: values are cut to their leading 16 bits, and the
    sums of weight, w d and w d^2 of the rests d are taken per (group, cut
    value), combined before the shuffle. The few sums of a group (a value's
    cut has 2^16 steps an octave at most) are then merged around the group's mean, so
    values far from zero lose no digits.
    """
    keys = as_list(keys)
    v, w = col(x).cast("double"), col(weight).cast("double")
    wide = v * F.lit(float(2 ** 37 + 1))
    cut = F.when(F.abs(v) < 1e290, wide - (wide - v)).otherwise(v)
    rows = df.where(w > 0).select(*map(col, keys), v.alias("__x"), cut.alias("__c"), w.alias("__w"))
    d = F.when(F.col("__x") != F.col("__c"), F.col("__x") - F.col("__c")).otherwise(F.when(F.col("__x").isNotNull(), F.lit(0.0)))
    sums = rows.groupBy(*keys, "__c").agg(F.sum("__w").alias("__w"), F.sum(F.col("__w") * d).alias("__s1"), F.sum(F.col("__w") * d * d).alias("__s2"))
    part = F.when(F.col("__c").isNotNull(), F.struct(F.col("__w").alias("w"), (F.col("__c") + F.col("__s1") / F.col("__w")).alias("m"),
                                                     F.greatest(F.col("__s2") - F.col("__s1") * F.col("__s1") / F.col("__w"), F.lit(0.0)).alias("q")))
    lists = sums.groupBy(*keys).agg(F.collect_list(part).alias("__l"), F.max(F.col("__c").isNull()).alias("__miss"))

    def total(of):
        return F.aggregate("__l", F.lit(0.0), lambda t, p: t + of(p))

    lists = lists.withColumn("__sw", total(lambda p: p["w"])).withColumn("__a", F.get("__l", 0)["m"])
    lists = lists.withColumn("__m", F.when(F.col("__sw") > 0, F.col("__a") + total(lambda p: p["w"] * (p["m"] - F.col("__a"))) / F.col("__sw")))
    var = total(lambda p: p["q"] + p["w"] * (p["m"] - F.col("__m")) * (p["m"] - F.col("__m"))) / (F.col("__sw") - 1)
    mean = F.col("__m") if na_rm_mean else F.when(~F.col("__miss"), F.col("__m"))
    return lists.select(*map(col, keys), mean.alias(mean_out), F.sqrt(F.when(F.col("__sw") > 1, var)).alias(sd_out))


def mean_sd(df: DataFrame, keys: Sequence[str], x: str, mean_out: str = "mean",
            sd_out: str = "sd", na_rm: bool = False) -> DataFrame:
    """Unweighted ``mean(x)`` and ``sd(x)`` per group."""
    return df.groupBy(*keys).agg(na_mean(x, na_rm).alias(mean_out), na_sd(x, na_rm).alias(sd_out))


# ------------------------------------------------------- A9 size at maturity

def size_at_maturity(maturity: DataFrame, taxon: Sequence[str], sex: str = "sex",
                     l50: str = "l50_mm", out: str = "lm") -> DataFrame:
    """Lowest L50 per taxon x sex (``slice(which.min)``), then the mean over
    sexes. Groups whose L50 is all missing drop out, as ``which.min`` gives
    no row. Two partial aggregations, no sort or window."""
    taxon = as_list(taxon)
    per_sex = (maturity.where(col(l50).isNotNull()).groupBy(*taxon, sex)
               .agg(F.min(l50).alias("__min")))
    return per_sex.groupBy(*taxon).agg(F.avg("__min").alias(out))


# ----------------------------------------------- A10-A12 abundance tables

def abundance_richness(maxn: DataFrame, sample_keys: Sequence[str], taxon: str = "scientific",
                       count: str = "count", skip_first: int = 0, long: bool = True,
                       order_cols: Sequence[str] | None = None,
                       response: str = "response", value: str = "number",
                       na_rm_richness: bool = False) -> DataFrame:
    """Total abundance and species richness per deployment, without a pivot.

    Equal to widening taxa to columns (absent = 0) and taking
    ``rowSums(na.rm = TRUE)`` for abundance and ``rowSums(. > 0)`` for
    richness; the latter has no ``na.rm`` in the reference, so a deployment
    with a missing MaxN gets missing richness (``na_rm_richness=True``
    counts only present values). ``skip_first=k`` reproduces a column-offset
    slip that leaves out the first k taxa in first-appearance order (T10):
    taxa are ranked by their smallest ``order_cols`` tuple (the grouping
    order rows come out in), the first k found by a distributed top-k and
    flagged (their cells take no part in either total).
    """
    sample_keys = as_list(sample_keys)
    data = maxn.withColumn("__keep", F.lit(True))
    if skip_first:
        oc = as_list(order_cols) or sample_keys
        first = (maxn.groupBy(taxon).agg(F.min(F.struct(*[col(c) for c in oc])).alias("__first"))
                 .orderBy(F.col("__first").asc(), col(taxon).asc()).limit(skip_first).select(taxon))
        flagged = maxn.join(F.broadcast(first.withColumn("__skip", F.lit(True))), on=taxon, how="left")   # <= k rows
        data = flagged.withColumn("__keep", col("__skip").isNull())
    keep, c = col("__keep"), col(count)
    richness = count_if(keep & (c > 0))
    if not na_rm_richness:
        richness = F.when(F.count(F.when(keep, c)) == F.count(F.when(keep, F.lit(1))), richness)
    wide = data.groupBy(*sample_keys).agg(
        F.coalesce(F.sum(F.when(keep, c)), F.lit(0)).cast("double").alias("total_abundance"),
        richness.cast("double").alias("species_richness"))
    if not long:
        return wide
    return wide.unpivot(sample_keys, ["total_abundance", "species_richness"], response, value)


def row_sum(df: DataFrame, cols: Sequence[str], out: str, na_rm: bool = True) -> DataFrame:
    """``rowSums(.[, cols])``; ``na_rm=True`` counts missing as 0."""
    terms = [F.coalesce(col(c), F.lit(0)) if na_rm else col(c) for c in cols]
    expr = terms[0]
    for t in terms[1:]:
        expr = expr + t
    return df.withColumn(out, expr)


def size_class_abundance(lengths: DataFrame, roster: DataFrame | None, sample_keys: Sequence[str],
                         length: str = "length_mm", number: str = "number", lm: str = "lm",
                         legal_mm: float = 280.0,
                         labels: Sequence[str] = ("Mature", "Immature", "Legal", "Sublegal"),
                         response: str = "response", value: str = "number",
                         focal=None) -> DataFrame:
    """Abundance by size class, zero-filled over the roster, stacked long.

    One scan and one aggregate give all four classes (the reference runs
    four filtered passes). Limits are strict (T13): a fish exactly at Lm or
    at the legal size is in neither class; a taxon without Lm is in neither
    maturity class.

    ``roster=None`` means the roster is the distinct deployments of
    ``lengths`` itself (the reference's length roster); then no join is
    needed: the aggregate runs over every length row with ``focal`` (a
    Column, e.g. the taxon test) folded into the conditional sums, so each
    deployment appears once with its zeros. With a separate roster the
    focal rows are aggregated and right-joined to it.
    """
    sample_keys = as_list(sample_keys)
    L, N = col(length), col(number)
    conds = [L > col(lm), L < col(lm), L > F.lit(legal_mm), L < F.lit(legal_mm)]
    names = [f"__c{i}" for i in range(4)]
    if roster is None:
        sel = focal if focal is not None else F.lit(True)
        filled = lengths.groupBy(*sample_keys).agg(
            *[F.coalesce(F.sum(F.when(sel & c, N)), F.lit(0)).alias(n) for c, n in zip(conds, names)])
    else:
        data = lengths.where(focal) if focal is not None else lengths
        agg = data.groupBy(*sample_keys).agg(*[F.sum(F.when(c, N)).alias(n) for c, n in zip(conds, names)])
        from abundance.operators.joins import natural_join
        filled = natural_join(agg, roster, how="right", on=sample_keys)
        filled = filled.withColumns({n: F.coalesce(col(n), F.lit(0)) for n in names})
    ids = [c for c in filled.columns if c not in names]
    stacked = filled.unpivot(ids, names, response, value)
    mapping = F.create_map(*[x for n, lab in zip(names, labels) for x in (F.lit(n), F.lit(lab))])
    return stacked.withColumn(response, mapping[col(response)])


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


# ------------------------------------------------------- A14-A15 QA stats

def audit(df: DataFrame, column: str) -> DataFrame:
    """One pass: rows, distinct values (a missing value counts as one, as
    R ``length(unique())`` does), missing count."""
    c = col(column)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.countDistinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))).cast("long").alias("n_distinct"),
        count_if(c.isNull()).alias("n_missing"),
    )


def missing_rows(df: DataFrame, column: str) -> DataFrame:
    """Rows where ``column`` is missing (``which(is.na(x))`` as rows)."""
    return df.where(col(column).isNull())


def describe_num(df: DataFrame, cols: Sequence[str], approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """R ``summary()`` of numeric columns, one row per column.

    Quartiles interpolate between order statistics (R type 7) found by
    selection (``select_ranks``: distributed, nothing of the columns' size is
    shuffled or collected); ``approx=True`` uses a fixed-size sketch without
    interpolation.
    """
    probs = [0.25, 0.5, 0.75]
    parts = []
    for c in cols:
        x = col(c).cast("double")
        q = F.percentile_approx(x, F.array(*map(F.lit, probs)), accuracy) if approx else F.lit(None).cast("array<double>")
        parts.append(F.struct(
            F.lit(c).alias("column"), F.min(x).alias("min"), q.alias("__q"), F.avg(x).alias("mean"),
            F.max(x).alias("max"), count_if(x.isNull()).alias("n_missing")).alias(c))
    kept = df if approx else df.select(*[col(c).cast("double").alias(c) for c in cols]).cache()
    long = kept.agg(*parts).select(F.explode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("s")).select("s.*")
    if not approx:
        found = quantiles(kept, cols, probs)
        rows = [(r["column"], r["min"], found[r["column"]], r["mean"], r["max"], r["n_missing"]) for r in long.collect()]    # one row per column
        kept.unpersist()
        long = df.sparkSession.createDataFrame(rows, "column string, min double, __q array<double>, mean double, max double, n_missing long")
    return long.select("column", "min", F.col("__q")[0].alias("q1"), F.col("__q")[1].alias("median"),
                       "mean", F.col("__q")[2].alias("q3"), "max", "n_missing")


def select_ranks(df: DataFrame, cols: Sequence[str], ranks, accuracy: int = 10_000, window: int = 50_000) -> dict[str, tuple[int, dict[int, float]]]:
    """Order statistics of several columns by selection: ``ranks(n)`` gives the
    0-based ranks wanted of a column of n present values; the result is
    {column: (n, {rank: value})}.

    Each wanted rank has an interval that holds it. A pass sketches the values
    inside every interval and narrows it to sketched bounds around the rank;
    the next pass counts exactly what lies below the bounds and between them,
    which confirms the narrower interval or takes the side that holds the
    rank. An interval shrinks about ``accuracy`` / 4 times a round; one with at
    most ``window`` values (or a single value) is read as (value, count) rows.
    Passes are aggregates of fixed size; at most ``window`` rows a rank are
    collected. Several passes read ``df``, so keep it if it is costly. NaN is
    missing.
    """
    cols, inf = list(cols), float("inf")
    x = {c: F.nanvl(col(c).cast("double"), F.lit(None)) for c in cols}
    size = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first() if cols else ()
    # (column, rank) -> [low, high, values below low, values inside], low <= value <= high
    open_ = {(c, k): [-inf, inf, 0, n] for c, n in zip(cols, size) for k in set(ranks(n)) if n}
    found: dict = {c: {} for c in cols}
    while open_:
        for key, (low, high, _, n) in list(open_.items()):
            if low == high:
                found[key[0]][key[1]] = low
                del open_[key]
        small = [key for key, v in open_.items() if v[3] <= window]
        large = [key for key in open_ if key not in set(small)]
        if small:
            spans = sorted({(c, *open_[c, k][:3]) for c, k in small})
            cells = [F.when((x[c] >= lo) & (x[c] <= hi), F.struct(F.lit(i).alias("i"), x[c].alias("x"))) for i, (c, lo, hi, _) in enumerate(spans)]
            rows = (df.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s")).groupBy("s.i", "s.x").count().collect())
            by_span: dict = {}
            for i, value, n in rows:
                by_span.setdefault(i, []).append((value, n))
            for i, (c, lo, hi, below) in enumerate(spans):
                wanted = sorted(k for d, k in small if d == c and tuple(open_[d, k][:2]) == (lo, hi))
                seen = below
                for value, n in sorted(by_span.get(i, [])):
                    while wanted and wanted[0] < seen + n:
                        found[c][wanted.pop(0)] = value
                    seen += n
            for key in small:
                del open_[key]
        if not large:
            continue
        spans = sorted({(c, *open_[c, k]) for c, k in large})
        asks = []
        for c, lo, hi, below, n in spans:
            at = sorted({min(max((k - below) / n + e, 0.0), 1.0) for d, k in large if d == c and tuple(open_[d, k]) == (lo, hi, below, n) for e in (-2.0 / accuracy, 2.0 / accuracy)})
            asks.append(at)
        inside = [F.when((x[c] >= lo) & (x[c] <= hi), x[c]) for c, lo, hi, _, _ in spans]
        marks = df.agg(*[F.percentile_approx(v, F.array(*map(F.lit, at)), accuracy).alias(f"m{i}") for i, (v, at) in enumerate(zip(inside, asks))]).first()
        # Bounds per rank: the marks on both sides of its share.
        bounds = {}
        for i, (c, lo, hi, below, n) in enumerate(spans):
            value = dict(zip(asks[i], marks[i]))
            for d, k in large:
                if d == c and tuple(open_[d, k]) == (lo, hi, below, n):
                    a, b = (min(max((k - below) / n + e, 0.0), 1.0) for e in (-2.0 / accuracy, 2.0 / accuracy))
                    bounds[d, k] = (value[a] if a > 0 else lo, value[b] if b < 1 else hi)
        pairs = sorted({(c, *bounds[c, k]) for c, k in large})
        counts = df.agg(*[F.count(F.when(test, 1)).alias(f"c{i}_{j}") for i, (c, lo, hi) in enumerate(pairs)
                          for j, test in enumerate((x[c] < lo, x[c] == lo, (x[c] > lo) & (x[c] < hi), x[c] == hi))]).first()
        for c, k in large:
            low, high, below, n = open_[c, k]
            lo, hi = bounds[c, k]
            b, at_lo, between, at_hi = counts[4 * pairs.index((c, lo, hi)):][:4]
            if lo == hi:
                at_hi = 0
            over = b + at_lo + between + at_hi
            if k < b:
                open_[c, k] = [low, math.nextafter(lo, -inf), below, b - below]
            elif k < b + at_lo:
                open_[c, k] = [lo, lo, b, at_lo]
            elif k < b + at_lo + between:
                open_[c, k] = [math.nextafter(lo, inf), math.nextafter(hi, -inf), b + at_lo, between]
            elif k < over:
                open_[c, k] = [hi, hi, b + at_lo + between, at_hi]
            else:
                open_[c, k] = [math.nextafter(hi, inf), high, over, n - (over - below)]
    return {c: (n, found[c]) for c, n in zip(cols, size)}


def rank_values(df: DataFrame, cols: Sequence[str], ranks, distinct: bool = False) -> dict[str, tuple[int, dict[int, float]]]:
    """Order statistics of several columns: ``ranks(n)`` gives the 0-based
    ranks wanted of a column of n present values; the result is {column: (n,
    {rank: value})}. ``distinct=True`` ranks the distinct values.

    The columns become (column, value, count) rows, combined before their
    shuffle (a heavily tied column is a few rows) and sorted by a range
    partitioning that is written to the checkpoint folder. The total of
    each partition (a few numbers per partition) gives the offset at which
    its ranks begin; a running sum inside each partition then finds all
    ranks in one job. Only the order statistics themselves are collected.
    """
    from pyspark.sql import Window

    from abundance.session import cut_lineage
    cols = list(cols)
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), col(c).cast("double").alias("x"))
                                          for i, c in enumerate(cols)])).alias("p")).select("p.*").where("x is not null")
    counted = pairs.groupBy("c", "x").agg((F.lit(1) if distinct else F.count(F.lit(1))).cast("long").alias("n"))
    placed = cut_lineage(counted.repartitionByRange("c", "x").withColumn("part", F.spark_partition_id()))
    totals = sorted((r["part"], r["c"], r["n"]) for r in placed.groupBy("part", "c").agg(F.sum("n").alias("n")).collect())
    size, begin = {}, []
    for part, c, n in totals:
        begin.append((part, c, size.get(c, 0)))
        size[c] = size.get(c, 0) + n
    wanted = [(c, k) for c, n in size.items() for k in sorted(set(ranks(n)))]
    value: dict[int, dict[int, float]] = {c: {} for c in size}
    if wanted:
        spark = df.sparkSession
        offsets = spark.createDataFrame(begin, "part int, c int, before long")       # one row per partition and column
        ks = spark.createDataFrame([(c, [k for d, k in wanted if d == c]) for c in size], "c int, ks array<long>")
        run = F.sum("n").over(Window.partitionBy("part", "c").orderBy("x"))
        rows = (placed.withColumn("run", run).join(F.broadcast(offsets), ["part", "c"]).join(F.broadcast(ks), "c")
                .select("c", "x", F.explode(F.filter("ks", lambda k: (k >= F.col("before") + F.col("run") - F.col("n"))
                                                     & (k < F.col("before") + F.col("run")))).alias("k")).collect())
        for r in rows:
            value[r["c"]][r["k"]] = r["x"]
    return {name: (size.get(i, 0), value.get(i, {})) for i, name in enumerate(cols)}


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], distinct: bool = False) -> dict[str, list[float | None]]:
    """Exact R type-7 quantiles of several columns (None for a column without values)."""
    def ranks(n):
        return [k for p in probs for k in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]

    out = {}
    for c, (n, value) in (rank_values(df, cols, ranks, True) if distinct else select_ranks(df, cols, ranks)).items():
        out[c] = [None] * len(probs)
        for i, p in enumerate(probs if n else ()):
            h = (n - 1) * p
            lo, hi = value[math.floor(h)], value[math.ceil(h)]
            out[c][i] = lo + (h - math.floor(h)) * (hi - lo)
    return out


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float]) -> list[float | None]:
    return quantiles(df, [column], probs)[column]


# --------------------------------------------------- A16-A19 correlations

def correlation(df: DataFrame, x: str, y: str, na_rm: bool = False, out: str = "r") -> DataFrame:
    return df.agg(na_corr(x, y, na_rm).alias(out))


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int | None = None,
                na_rm: bool = False) -> DataFrame:
    """Pairwise Pearson correlations as a long table (var1, var2, r), upper
    triangle in column order, all from one aggregate pass. ``digits`` rounds
    half-to-even like R ``round``."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    structs = []
    for a, b in pairs:
        r = na_corr(a, b, na_rm)
        if digits is not None:
            r = F.bround(r, digits)
        structs.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), r.alias("r")))
    one = df.agg(F.array(*structs).alias("__pairs"))
    return one.select(F.explode("__pairs").alias("p")).select("p.*")


def collinear_pairs(df: DataFrame, cols: Sequence[str], cutoff: float = 0.95,
                    na_rm: bool = False) -> DataFrame:
    """Predictor pairs with |r| above ``cutoff`` (candidates to drop)."""
    return corr_matrix(df, cols, na_rm=na_rm).where(F.abs(col("r")) > F.lit(cutoff))


def zero_fraction(df: DataFrame, group: str, value: str, threshold: float | None = 0.95,
                  out: str = "zero_fraction") -> DataFrame:
    """Share of zeros per response; with ``threshold`` keep only responses
    below it (strict ``<``). Missing values count in the denominator only."""
    res = df.groupBy(group).agg(
        (F.sum(F.when(col(value) == 0, 1).otherwise(0)) / F.count(F.lit(1))).alias(out))
    return res.where(col(out) < threshold) if threshold is not None else res


# ------------------------------------------------------ A20-A22 summaries

def mean_se(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """ggplot ``mean_se``: mean and mean +/- standard error, NA removed."""
    m = F.avg(col(x))
    se = F.stddev_samp(col(x)) / F.sqrt(F.count(col(x)).cast("double"))
    return (df.groupBy(*keys).agg(m.alias("mean"), se.alias("se"))
            .withColumn("ymin", col("mean") - col("se")).withColumn("ymax", col("mean") + col("se")))


def group_mean(df: DataFrame, keys: Sequence[str], cols: dict[str, str]) -> DataFrame:
    """Mean of several columns per group, {out: column}."""
    return df.groupBy(*keys).agg(*[F.avg(col(c)).alias(o) for o, c in cols.items()])


def lm_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line y ~ x in one pass: slope, intercept, n, residual
    variance pieces (the data part of ``geom_smooth(method="lm")``)."""
    both = df.where(col(x).isNotNull() & col(y).isNotNull())
    return both.agg(
        F.regr_slope(col(y), col(x)).alias("slope"),
        F.regr_intercept(col(y), col(x)).alias("intercept"),
        F.regr_count(col(y), col(x)).alias("n"),
        F.regr_sxx(col(y), col(x)).alias("sxx"),
        F.regr_syy(col(y), col(x)).alias("syy"),
        F.regr_sxy(col(y), col(x)).alias("sxy"),
        F.regr_avgx(col(y), col(x)).alias("xbar"),
        F.min(col(x)).alias("xmin"), F.max(col(x)).alias("xmax"))


def lm_band(df: DataFrame, x: str, y: str, n_points: int = 80, level: float = 0.95) -> DataFrame:
    """Fitted line and confidence band on ``n_points`` equally spaced x.

    The one-row fit joins the generated grid (no driver round trip except
    the t quantile, which depends only on n)."""
    from abundance.functions.stats import t_quantile
    r = lm_fit(df, x, y).first().asDict()          # one row of sums
    n = r["n"]
    tq = t_quantile(0.5 + level / 2.0, max(n - 2, 1)) if n and n > 2 else float("nan")
    grid = df.sparkSession.range(n_points).withColumnRenamed("id", "__i")
    lit = {k: F.lit(v) for k, v in r.items()}
    xv = lit["xmin"] + (lit["xmax"] - lit["xmin"]) * col("__i") / F.lit(max(n_points - 1, 1))
    s2 = (lit["syy"] - lit["sxy"] * lit["sxy"] / lit["sxx"]) / (lit["n"] - 2)
    se = F.sqrt(s2 * (F.lit(1.0) / lit["n"] + (xv - lit["xbar"]) ** 2 / lit["sxx"]))
    fitted = lit["intercept"] + lit["slope"] * xv
    g = grid
    return g.select(xv.alias(x), fitted.alias("fit"), se.alias("se"),
                    (fitted - F.lit(tq) * se).alias("lower"), (fitted + F.lit(tq) * se).alias("upper"))


# ------------------------------------------------ class composition

def class_composition(df: DataFrame, sample_keys: Sequence[str], class_col: str, weight: str,
                      classes: Sequence[str], total_out: str = "total_points_annotated",
                      other_out: str = "unclassified", long: bool = True,
                      names_to: str = "habitat", values_to: str = "number") -> DataFrame:
    """Weighted tally per deployment x class, absent classes 0, with the
    deployment total (all rows, classified or not, trap T8) attached.

    Equal to ``tally(wt)`` by (sample, class) -> group total -> widen
    (fill 0) -> lengthen the listed classes, but computed as one partial
    aggregate by deployment (conditional sums over the known ``classes``),
    so it costs a single shuffle and no pivot pass.
    """
    w, k = col(weight), col(class_col)
    parts = [F.coalesce(F.sum(F.when(k == F.lit(c), w)), F.lit(0)).alias(c) for c in classes]
    other = F.coalesce(F.sum(F.when(k.isNull(), w)), F.lit(0)).alias(other_out)
    wide = df.groupBy(*sample_keys).agg(F.coalesce(F.sum(w), F.lit(0)).alias(total_out), other, *parts)
    if not long:
        return wide
    return wide.unpivot([*sample_keys, total_out, other_out], list(classes), names_to, values_to)
