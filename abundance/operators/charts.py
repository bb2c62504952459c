"""Chart-feeding tables (survey IDs V1-V6). Drawing is not built; these
produce the rows a plotting tool needs, computed on Spark."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abundance.functions.columns import as_list, col


# ------------------------------------------------------------ V1 histogram

def pretty_breaks(lo: float, hi: float, n: int, min_n: int | None = None) -> list[float]:
    """About ``n`` round intervals that cover [lo, hi].

    The step is 1, 2, 5 or 10 times a power of ten, whichever the ideal
    width (span / n) calls for: above 1.4, 2.8 and 7 powers of ten the next
    larger one is taken (the balance between too many and too few intervals
    that R's ``pretty`` uses by default). Breaks are the multiples of the
    step from the last at or below lo to the first at or above hi; fewer
    than ``min_n`` intervals are padded on both sides, the odd one towards
    the sign of lo.
    """
    least = n // 3 if min_n is None else min_n
    span, size = hi - lo, max(abs(lo), abs(hi))
    if span <= size * max(1, n) * 4.2e-16 or size == 0:
        # (Nearly) equal ends: intervals of the values' own size, damped when large.
        ideal = (size if size <= 10 else 9 + size / 10) or 1.0
        ideal /= max(1, least)
    else:
        ideal = span / max(1, n)
    power = 10.0 ** math.floor(math.log10(ideal))
    step = power * next(m for m, bound in ((1, 1.4), (2, 2.8), (5, 7.0), (10, math.inf)) if ideal <= bound * power)
    first, last = math.floor(lo / step + 1e-7), math.ceil(hi / step - 1e-7)
    missing = least - (last - first)
    if missing > 0:
        first -= missing // 2 + (missing % 2 if lo >= 0 else 0)
        last += missing // 2 + (missing % 2 if lo < 0 else 0)
    return [i * step for i in range(first, last + 1)]


def hist_bins(df: DataFrame, column: str, bins: int | str = "sturges") -> DataFrame:
    """Histogram counts with empty bins kept.

    ``bins="sturges"``: R ``hist`` (Sturges class count, ``pretty``
    breaks, right-closed, first bin closed on both sides).
    ``bins=k``: ggplot ``geom_histogram(bins=k)`` (width range/(k-1),
    centred on the minimum, right-closed).
    One aggregate pass for (min, max, n), breaks on the driver (a handful
    of numbers), one grouped count, joined to the generated bin grid.
    """
    x = col(column).cast("double")
    st = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).first()
    lo, hi, n = st["lo"], st["hi"], st["n"]
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], "bin int, lower double, upper double, count bigint")
    if bins == "sturges":
        k = math.ceil(math.log2(n) + 1)
        br = pretty_breaks(lo, hi, k, min_n=1)          # hist() passes min.n = 1
        start, width, nb = br[0], br[1] - br[0], len(br) - 1
    else:
        nb = int(bins)
        # One bin spans the data; otherwise the outer bins are centred on the extremes.
        width = ((hi - lo) / (nb - 1) if nb > 1 else hi - lo) if hi > lo else 1.0
        start = lo - width / 2 if nb > 1 or hi == lo else lo
    fuzz = 1e-7 * width
    idx = F.greatest(F.ceil((x - F.lit(start) - F.lit(fuzz)) / F.lit(width)), F.lit(1)).cast("int")
    counts = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = spark.range(1, nb + 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(start) + (F.col("id") - 1) * F.lit(width)).alias("lower"),
        (F.lit(start) + F.col("id") * F.lit(width)).alias("upper"))
    return (grid.join(F.broadcast(counts), on="bin", how="left")     # <= nb rows (one per bin)
            .withColumn("count", F.coalesce(F.col("count"), F.lit(0)).cast("long")))


# ---------------------------------------------------- V2-V3 map layers

def rescale(df: DataFrame, column: str, out: str | None = None, domain: tuple | None = None) -> DataFrame:
    """Palette position in [0, 1] over the column's domain (missing stays
    missing). The domain (two numbers) comes from one aggregate pass."""
    out = out or f"{column}_pos"
    if domain is None:
        r = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        domain = (r["lo"], r["hi"])
    lo, hi = domain
    span = (hi - lo) if lo is not None and hi is not None and hi != lo else None
    expr = (col(column) - F.lit(lo)) / F.lit(span) if span else F.lit(None).cast("double")
    return df.withColumn(out, expr)


def map_points(df: DataFrame, lon: str, lat: str, value: str, label: str,
               radius: str | float = "value/5") -> DataFrame:
    """Circle-marker layer: lon, lat, radius (``value/5``, ``value`` or a
    constant), colour position over the value domain, label text."""
    if radius == "value/5":
        r = col(value) / 5.0
    elif radius == "value":
        r = col(value).cast("double")
    else:
        r = F.lit(float(radius))
    pts = df.select(col(lon).alias("lon"), col(lat).alias("lat"), col(value).alias("value"),
                    r.alias("radius"), col(label).cast("string").alias("label"))
    return rescale(pts, "value", "colour")


# ---------------------------------------------------- V4 composition

def composition_shares(df: DataFrame, keys: Sequence[str], class_col: str, value: str,
                       out: str = "share") -> DataFrame:
    """Pie shares: each class's share of its deployment's total (groups are
    the classes of one deployment, so the window is bounded)."""
    w = Window.partitionBy(*as_list(keys))
    return df.withColumn(out, F.try_divide(col(value).cast("double"), F.sum(col(value)).over(w)))


# ---------------------------------------------------- V5 scatter sample

def scatter_points(df: DataFrame, x: str, y: str, fraction: float | None = None,
                   seed: int = 42) -> DataFrame:
    """Two columns for a scatter plot; ``fraction`` draws a Bernoulli sample
    for very large tables (sampling is the feature here)."""
    pts = df.select(col(x), col(y)).where(col(x).isNotNull() & col(y).isNotNull())
    return pts.sample(fraction=fraction, seed=seed) if fraction else pts


def scatter_sample(df: DataFrame, x: str, y: str, key: Sequence[str], k: int) -> DataFrame:
    """At most ``k`` points for a scatter plot of a table of any size: the rows
    whose key has the smallest MD5 (ties by key), so the same rows on every
    run and any layout. Spark plans it as a distributed top-k: a task sends k
    rows at most. The limit is the feature here."""
    pts = df.where(col(x).isNotNull() & col(y).isNotNull())
    keys = as_list(key)
    text = F.concat_ws("|", *[F.coalesce(col(c).cast("string"), F.lit("")) for c in keys])
    return pts.orderBy(F.md5(text), *[col(c).asc_nulls_first() for c in keys], x, y).limit(k).select(*map(col, keys), col(x), col(y))


# ---------------------------------------------------- V6 curve with bands

def curve_with_se(pred: DataFrame, x: str, fit: str = "fit", se: str = "se_fit") -> DataFrame:
    """Prediction curve with +/- se lines (from ``models.predict``)."""
    return pred.select(col(x), col(fit), (col(fit) - col(se)).alias("lower"), (col(fit) + col(se)).alias("upper"))
