"""Composite survey workflows (survey IDs C1-C15), built from operators.

Inputs are survey-shaped DataFrames (deployment roster, counts, lengths,
benthos, relief, dot points); column names are parameters with the usual
survey defaults. Every function returns a lazy DataFrame: one Spark plan
per workflow, written out only where the caller saves it (sources.io).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundance.functions.columns import as_list, col, keep_predicate, taxon_label, to_number
from abundance.operators import agg, clean, joins, rank, reshape

DEPLOYMENT_COLS = ["sample", "longitude_dd", "latitude_dd", "date_time", "location", "site",
                   "depth_m", "successful_count", "successful_length", "successful_habitat_forward"]


def deployment_roster(meta: DataFrame, keep: Sequence[str] | None = None,
                      success_col: str = "successful_count", success="Yes") -> DataFrame:
    """Clean names, keep the roster columns, successful deployments only."""
    m = clean.clean_names(meta)
    keep = [c for c in (keep or DEPLOYMENT_COLS) if c in m.columns]
    return clean.keep_in(m.select(*keep), success_col, [success])


def complete_counts(counts: DataFrame, rules: Sequence[tuple], keys: Sequence[str] = ("sample",),
                    taxon_parts: Sequence[str] = ("family", "genus", "species"),
                    success_col: str = "successful_count", count: str = "count",
                    na_rm: bool = False, rename: dict | None = None) -> DataFrame:
    """Successful rows, taxon relabels, 3-part label, MaxN per
    deployment x taxon (``summarise(count = max(count))``)."""
    c = clean.keep_in(counts, success_col, ["Yes"])
    c = clean.relabel(c, rules)
    c = c.withColumn("scientific", taxon_label(*taxon_parts))
    out = agg.max_n(c, [*keys, *taxon_parts, "scientific"], count=count, na_rm=na_rm)
    return clean.rename(out, rename) if rename else out


def complete_lengths(lengths: DataFrame, rules: Sequence[tuple],
                     taxon_parts: Sequence[str] = ("family", "genus", "species"),
                     success_col: str = "successful_length", rename: dict | None = None) -> DataFrame:
    """Successful length rows, relabelled, with a taxon label."""
    c = clean.keep_in(lengths, success_col, ["Yes"])
    c = clean.relabel(c, rules).withColumn("scientific", taxon_label(*taxon_parts))
    return clean.rename(c, rename) if rename else c


def abundance_long(maxn: DataFrame, sample_keys: Sequence[str] = ("sample",), skip_first: int = 0,
                   order_cols: Sequence[str] | None = None) -> DataFrame:
    """C4: total abundance / species richness per deployment, long form."""
    return agg.abundance_richness(maxn, list(sample_keys), skip_first=skip_first, order_cols=order_cols)


def benthos_composition(benthos: DataFrame, rules: Sequence[tuple], classes: Sequence[str],
                        sample_keys: Sequence[str] = ("sample",), weight: str = "number") -> DataFrame:
    """Classify annotations (no default), weighted tally per class,
    deployment total, long over the named classes."""
    b = clean.classify(benthos, rules, "habitat")
    return agg.class_composition(b, list(sample_keys), "habitat", weight, classes)


def relief_summary(relief: DataFrame, sample_keys: Sequence[str] = ("sample",), score: str = "level_5",
                   weight: str = "number") -> DataFrame:
    """Mean and sd of relief replicated by multiplicity (no row
    explosion); bad score text -> NULL -> mean NULL (R rules)."""
    r = relief.withColumn("__score", to_number(score))
    return agg.weighted_moments(r, list(sample_keys), "__score", weight,
                                mean_out="mean_relief", sd_out="sd_relief")


def percent_cover(composition_wide: DataFrame, classes: Sequence[str],
                  total: str = "total_points_annotated") -> DataFrame:
    """Percent of annotated points per class (``number / total * 100``)."""
    return composition_wide.select(
        *[c for c in composition_wide.columns if c not in classes],
        *[(F.try_divide(col(c).cast("double"), col(total).cast("double")) * 100.0).alias(c)
          for c in classes])


def habitat_table(roster: DataFrame, benthos: DataFrame, relief: DataFrame, rules: Sequence[tuple],
                  classes: Sequence[str], key: str = "sample", literal: bool = False) -> DataFrame:
    """Per deployment percent cover of each class + relief mean / sd,
    left-joined to the roster.

    ``literal=False`` (default): a deployment with no benthos rows has NULL
    cover. ``literal=True`` reproduces ``values_fill = 0`` (false zeros, T9).

    Plan: the classified benthos rows and the relief rows are stacked by
    key and reduced by one ``groupBy(key)`` (one shuffle for both fact
    tables; numeric sums only, so hash aggregation with a map-side partial
    step): class sums and the total over benthos rows (NULL when a
    deployment has none), weighted relief moments over relief rows of
    positive weight. One left join attaches the result to the roster.
    ``habitat_table_joined`` builds the same table from two aggregates and
    two joins (kept as the reference in tests).
    """
    b = clean.classify(benthos, rules, "habitat").select(
        col(key), F.lit(1).alias("__src"), col("habitat").alias("__cls"), col("number").cast("double").alias("__w"))
    r = relief.select(col(key), F.lit(2).alias("__src"), to_number("level_5").alias("__x"),
                      col("number").cast("double").alias("__w"))
    stacked = b.unionByName(r, allowMissingColumns=True)
    src, w, x, cls = col("__src"), col("__w"), col("__x"), col("__cls")
    isb, isr = src == 1, (src == 2) & (w > 0)
    nb = F.sum(F.when(isb, 1).otherwise(0))
    total = F.coalesce(F.sum(F.when(isb, w)), F.lit(0.0))
    cover = [F.when(nb > 0, F.try_divide(F.coalesce(F.sum(F.when(isb & (cls == F.lit(c)), w)), F.lit(0.0)), total)
                    * 100.0).alias(c) for c in classes]
    sw = F.sum(F.when(isr & x.isNotNull(), w))
    s1, s2 = F.sum(F.when(isr, w * x)), F.sum(F.when(isr, w * x * x))
    complete = F.count(F.when(isr, x)) == F.count(F.when(isr, F.lit(1)))
    per_key = stacked.groupBy(key).agg(
        F.when(nb > 0, total.cast("long")).alias("total_points_annotated"), *cover,
        F.when(complete, s1 / sw).alias("mean_relief"),
        F.sqrt(F.when(sw > 1, F.greatest((s2 - s1 * s1 / sw) / (sw - 1), F.lit(0.0)))).alias("sd_relief"))
    out = joins.natural_join(roster, per_key, "left", on=[key])
    if literal:
        out = clean.fill_missing(out, classes, 0.0)
    return out


def habitat_table_joined(roster: DataFrame, benthos: DataFrame, relief: DataFrame, rules: Sequence[tuple],
                         classes: Sequence[str], key: str = "sample", literal: bool = False) -> DataFrame:
    """C7 built with two left joins (composition, relief) on the roster."""
    b = clean.classify(benthos, rules, "habitat")
    comp = agg.class_composition(b, [key], "habitat", "number", classes, long=False)
    cover = percent_cover(comp, classes).drop("unclassified")
    rel = relief_summary(relief, [key])
    out = joins.natural_join(roster, cover, "left", on=[key])
    out = joins.natural_join(out, rel, "left", on=[key])
    if literal:
        out = clean.fill_missing(out, classes, 0.0)
    return out


def model_frame(abund: DataFrame, habitat: DataFrame, response: str = "total_abundance",
                key: str = "sample", drop_sample=None, date_time: str = "date_time") -> DataFrame:
    """One response joined to habitat, a named deployment removed,
    local date and time split from the text timestamp."""
    a = clean.keep_in(abund, "response", [response])
    f = joins.natural_join(a, habitat, "left", on=[key])
    if drop_sample is not None:
        f = clean.exclude_value(f, key, drop_sample)
    return clean.split_local_datetime(f, date_time)


def species_with_zeros(maxn: DataFrame, roster: DataFrame, habitat: DataFrame | None, label: str,
                       key: str = "sample", taxon: str = "scientific", count: str = "count",
                       sum_keys: Sequence[str] | None = None) -> DataFrame:
    """One taxon's summed MaxN for every deployment, true zeros filled.

    The taxon filter sits on a grouping key, so Catalyst pushes it below the
    aggregate (and into the scan when the label is a stored column).
    """
    keys = as_list(sum_keys) or [key, taxon]
    s = agg.sum_counts(clean.keep_in(maxn, taxon, [label]), keys, count=count)
    out = joins.natural_join(s, roster, "right", on=[key])
    if habitat is not None:
        out = joins.natural_join(out, habitat, "left", on=[key])
    return clean.fill_missing(out, [count], 0)


def size_class_table(lengths: DataFrame, maturity: DataFrame, label: str, legal_mm: float = 280.0,
                     key: Sequence[str] = ("sample",), taxon_parts: Sequence[str] = ("family", "genus", "species"),
                     label_parts: Sequence[str] = ("genus", "species"),
                     roster_cols: Sequence[str] = ("sample",), suffix: str | None = None) -> DataFrame:
    """C11: Lm per taxon (lowest L50 per sex, mean over sexes), lengths of
    one taxon classed mature / immature / legal / sublegal, zero-filled over
    every deployment with lengths, stacked long (one scan, one aggregate)."""
    lm = agg.size_at_maturity(maturity, list(taxon_parts), out="lm")
    ln = clean.keep_in(lengths, "successful_length", ["Yes"]).withColumn("scientific", taxon_label(*label_parts))
    ln = joins.natural_join(ln, lm, "left", on=list(taxon_parts))
    sfx = f" {suffix}" if suffix else ""
    labels = [f"Mature{sfx}", f"Immature{sfx}", f"Legal{sfx}", f"Sublegal{sfx}"]
    focal = keep_predicate("scientific", [label])
    if list(roster_cols) == list(key):
        # the roster is the distinct deployments of the lengths: one aggregate, no join
        return agg.size_class_abundance(ln, None, list(key), lm="lm", legal_mm=legal_mm, labels=labels,
                                        focal=focal)
    roster = agg.distinct_rows(ln, list(roster_cols))
    return agg.size_class_abundance(ln, roster, list(key), lm="lm", legal_mm=legal_mm, labels=labels,
                                    focal=focal)


def dot_point_habitat(points: DataFrame, keys: Sequence[str] = ("campaignid", "opcode"),
                      class_col: str = "broad", levels: Sequence[str] | None = None) -> DataFrame:
    """C12 (habitat part): drop Unknown / missing / blank classes, count
    points per class, widen (absent = 0), clean names, row total."""
    keys = list(keys)
    p = clean.exclude_values(points.select(*keys, class_col), class_col, ["Unknown", None, ""])
    n = agg.point_count(p, [*keys, class_col], out="number")
    wide = clean.clean_names(reshape.widen(n, keys, class_col, "number", fill=0, levels=levels))
    cls = [c for c in wide.columns if c not in keys]
    return agg.row_sum(wide, cls, "total_points_annotated")


def dot_point_relief(points: DataFrame, keys: Sequence[str] = ("campaignid", "opcode"),
                     score: str = "level_5") -> DataFrame:
    """C12 (relief part): drop missing / blank scores, numeric, mean and sd
    per deployment without ``na.rm`` (bad text -> NULL -> NULL stats)."""
    p = clean.exclude_values(points.select(*keys, score), score, [None, ""])
    p = p.withColumn(score, to_number(score))
    return agg.mean_sd(p, list(keys), score, "mean_relief", "sd_relief", na_rm=False)


def single_species_response(maxn: DataFrame, label: str, response: str,
                            taxon: str = "scientific") -> DataFrame:
    """One taxon's rows labelled with a response name."""
    return clean.with_constant(clean.keep_in(maxn, taxon, [label]), "response", response)


def importance_long(imp_wide: DataFrame, id_col: str, rename_to: str = "resp_var",
                    label_rule: tuple | None = None) -> DataFrame:
    """C14: variable-importance wide table -> long (response, predictor,
    importance) + optional label via a no-default case_when."""
    d = clean.rename(imp_wide, {id_col: rename_to})
    d = reshape.lengthen(d, ids=[rename_to], names_to="predictor", values_to="importance", cast="double")
    if label_rule is not None:
        d = clean.classify(d, [label_rule], "label")
    return d


def model_report(models: DataFrame, response: str = "response", aic: str = "aicc",
                 max_delta: float = 10.0) -> DataFrame:
    """Per response: delta to best, Akaike weights, cumulative weight
    in AIC order, keep delta <= max_delta. Weights are computed before the
    cut, so kept weights need not sum to 1. Groups are candidate models of
    one response, bounded by the model cap, so windows are safe here."""
    m = rank.delta_to_best(models, [response], aic, out="delta_aicc")
    m = rank.akaike_weights(m, [response], "delta_aicc", out="wi_aicc")
    m = rank.running_total(m, [response], [aic, "modname"], "wi_aicc", out="cumsum_wi")
    return m.where(col("delta_aicc") <= max_delta)


def qa_report(roster: DataFrame, table: DataFrame, key: Sequence[str] = ("sample",),
              names: tuple[str, str] = ("roster", "table")) -> DataFrame:
    """Row counts of both tables and the rows each has without a
    partner in the other (two-way anti join counts).

    Both key lists are stacked and grouped once (partial aggregation, one
    shuffle, no join); grouping puts missing keys in one group, which is
    R's NA-matches-NA rule without a null-safe join."""
    key = list(key)
    a = roster.select(*key, F.lit(1).alias("__a"), F.lit(0).alias("__b"))
    b = table.select(*key, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    per_key = a.unionByName(b).groupBy(*key).agg(F.sum("__a").alias("__na"), F.sum("__b").alias("__nb"))
    na, nb = col("__na"), col("__nb")
    one = per_key.agg(F.sum(na).cast("long").alias(f"{names[0]}_rows"),
                      F.sum(nb).cast("long").alias(f"{names[1]}_rows"),
                      F.sum(F.when(nb == 0, na).otherwise(0)).cast("long").alias(f"{names[0]}_only"),
                      F.sum(F.when(na == 0, nb).otherwise(0)).cast("long").alias(f"{names[1]}_only"))
    return one.unpivot([], one.columns, "check", "value")
