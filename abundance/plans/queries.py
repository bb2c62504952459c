"""Registered queries over the driver tables, each with its DuckDB oracle.

``QUERIES[name] = (spark_fn, sql_or_None)``. ``spark_fn(spark, sf_dir)``
returns a lazy DataFrame over whole tables; ``sql`` is the same question
in SQL against the pre-registered views. Doubles are rounded to 6 places
on both sides (4 for model output) so the value hashes compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundance.functions.columns import taxon_label
from abundance.operators import agg, clean, joins, rank, reshape
from abundance.plans import pipelines as P
from abundance.plans import views as V
from abundance.plans.model_sql import coef_rows, glm_ctes, zip_ctes

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return deco


def fin(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (oracle rule); no negative zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


RULES = [
    ("species", V.RELABEL_SPECIES_TO, {"species": V.RELABEL_SPECIES_FROM}),
    ("genus", V.RELABEL_GENUS_TO, {"genus": V.RELABEL_GENUS_FROM, "family": V.RELABEL_GENUS_FAMILY}),
]
TAXON = ["family", "genus", "species"]


# ------------------------------------------------------------ shared parts

def _roster(spark, d):
    return clean.keep_in(V.roster(spark, d, successful=True), "successful_count", ["Yes"])


def _maxn(spark, d, with_missing=False):
    return P.complete_counts(V.counts(spark, d, with_missing, successful=True), RULES, keys=["sample"], taxon_parts=TAXON)


def _habitat(spark, d, literal=False):
    return P.habitat_table(
        _roster(spark, d).select("sample", "site", "depth_m", "date_time"),
        V.benthos(spark, d), V.relief(spark, d), V.HABITAT_RULES, V.HABITAT_CLASSES, literal=literal)


def _with(*ctes: tuple[str, str]) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({s})" for n, s in ctes)


ROSTER_OK = ("roster_ok", f"SELECT * FROM ({V.ROSTER_SQL}) WHERE successful_count = 'Yes'")


def maxn_ctes(with_missing=False):
    return [
        ("counts_v", V.counts_sql(with_missing)),
        ("c1", """SELECT sample, family,
            CASE WHEN genus = 'Brand#1' AND family = 'ECONOMY' THEN 'Brand#0' ELSE genus END AS genus,
            CASE WHEN species = 'red widget' THEN 'spp' ELSE species END AS species, count
            FROM counts_v WHERE successful_count = 'Yes'"""),
        ("maxn", """SELECT sample, family, genus, species,
            coalesce(family,'NA') || ' ' || coalesce(genus,'NA') || ' ' || coalesce(species,'NA') AS scientific,
            CASE WHEN count(count) = count(*) THEN max(count) END AS count
            FROM c1 GROUP BY 1, 2, 3, 4, 5"""),
    ]


CLASSIFIED = ("classified", f"SELECT *, {V.HABITAT_CASE_SQL} AS habitat FROM ({V.BENTHOS_SQL})")
COMPOSITION = ("composition", """SELECT sample,
    CAST(coalesce(sum(number), 0) AS BIGINT) AS total_points_annotated,
    CAST(coalesce(sum(CASE WHEN habitat IS NULL THEN number END), 0) AS BIGINT) AS unclassified,
    CAST(coalesce(sum(CASE WHEN habitat = 'posidonia' THEN number END), 0) AS BIGINT) AS posidonia,
    CAST(coalesce(sum(CASE WHEN habitat = 'sand' THEN number END), 0) AS BIGINT) AS sand,
    CAST(coalesce(sum(CASE WHEN habitat = 'turf' THEN number END), 0) AS BIGINT) AS turf
    FROM classified GROUP BY sample""")
RELIEF_SUM = ("relief_sum", f"""SELECT sample,
    CASE WHEN count(x) = count(*) THEN sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END) END AS mean_relief,
    CASE WHEN sum(CASE WHEN x IS NOT NULL THEN w END) > 1 THEN sqrt(greatest(
      (sum(w * x * x) - sum(w * x) * sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END))
      / (sum(CASE WHEN x IS NOT NULL THEN w END) - 1), 0)) END AS sd_relief
    FROM (SELECT sample, TRY_CAST(level_5 AS DOUBLE) AS x, CAST(number AS DOUBLE) AS w FROM ({V.RELIEF_SQL}))
    WHERE w > 0 GROUP BY sample""")
HABITAT = ("habitat", """SELECT r.sample, r.site, r.depth_m, r.date_time,
    c.total_points_annotated,
    100.0 * c.posidonia / nullif(c.total_points_annotated, 0) AS posidonia,
    100.0 * c.sand / nullif(c.total_points_annotated, 0) AS sand,
    100.0 * c.turf / nullif(c.total_points_annotated, 0) AS turf,
    s.mean_relief, s.sd_relief
    FROM roster_ok r LEFT JOIN composition c ON r.sample = c.sample
    LEFT JOIN relief_sum s ON r.sample = s.sample""")
HABITAT_CTES = [ROSTER_OK, CLASSIFIED, COMPOSITION, RELIEF_SUM, HABITAT]


# =============================================================== flagship

@register("species_true_zeros", _with(ROSTER_OK, *maxn_ctes(), ("s", f"""
    SELECT sample, genus || ' ' || species AS label2, CAST(sum(count) AS BIGINT) AS count
    FROM maxn WHERE genus || ' ' || species = '{V.FOCAL_LABEL}' GROUP BY 1, 2""")) + """
SELECT r.sample, s.label2, coalesce(s.count, 0) AS count, r.campaignid, r.site, ROUND(r.depth_m, 6) AS depth_m
FROM s RIGHT JOIN roster_ok r ON s.sample = r.sample""")
def species_true_zeros(spark, d):
    """One taxon's summed MaxN per deployment with true zeros."""
    m = _maxn(spark, d).withColumn("label2", taxon_label("genus", "species"))
    r = _roster(spark, d).select("sample", "campaignid", "site", "depth_m")
    return fin(P.species_with_zeros(m, r, None, V.FOCAL_LABEL, taxon="label2", sum_keys=["sample", "label2"]))


# ================================================== sources / projections

@register("deployment_roster", _with(ROSTER_OK) + """
SELECT sample, ROUND(longitude_dd, 6) AS longitude_dd, ROUND(latitude_dd, 6) AS latitude_dd, date_time,
       site, ROUND(depth_m, 6) AS depth_m, successful_count, successful_length, successful_habitat_forward
FROM roster_ok""")
def deployment_roster(spark, d):
    """C1 (P1, P2, P13): roster columns, successful deployments."""
    return fin(P.deployment_roster(V.roster(spark, d)))


@register("relabel_taxa", _with(("counts_v", V.counts_sql())) + """
SELECT sample, family,
  CASE WHEN genus = 'Brand#1' AND family = 'ECONOMY' THEN 'Brand#0' ELSE genus END AS genus,
  CASE WHEN species = 'red widget' THEN 'spp' ELSE species END AS species,
  coalesce(family,'NA') || ' ' ||
  coalesce(CASE WHEN genus = 'Brand#1' AND family = 'ECONOMY' THEN 'Brand#0' ELSE genus END,'NA') || ' ' ||
  coalesce(CASE WHEN species = 'red widget' THEN 'spp' ELSE species END,'NA') AS scientific,
  count AS number, 'Abundance' AS response
FROM counts_v""")
def relabel_taxa(spark, d):
    """Relabel rules in order, 3-part label, rename, constant."""
    c = clean.relabel(V.counts(spark, d), RULES).withColumn("scientific", taxon_label(*TAXON))
    c = clean.with_constant(clean.rename(c, {"count": "number"}), "response", "Abundance")
    return c.drop("successful_count")


@register("classify_habitat", _with(CLASSIFIED) + """
SELECT sample, level_2, level_3, scientific, number, habitat FROM classified""")
def classify_habitat(spark, d):
    """case_when without default (unmatched -> NULL)."""
    return clean.classify(V.benthos(spark, d), V.HABITAT_RULES, "habitat")


@register("text_to_number", f"""
SELECT sample, level_5, TRY_CAST(level_5 AS DOUBLE) AS score, number FROM ({V.RELIEF_SQL})""")
def text_to_number(spark, d):
    """As.numeric on text, bad text -> NULL (no ANSI error)."""
    return V.relief(spark, d).withColumn("score", F.col("level_5").try_cast("double")).select(
        "sample", "level_5", "score", "number")


@register("factor_levels", _with(ROSTER_OK) + """
SELECT sample, site, CAST(dense_rank() OVER (ORDER BY site) AS INTEGER) AS site_level FROM roster_ok""")
def factor_levels(spark, d):
    """Alphabetic factor level index."""
    return clean.factor_levels(_roster(spark, d).select("sample", "site"), "site", "site_level")


@register("local_date_time", _with(ROSTER_OK) + """
SELECT sample, date_time, substr(date_time, 1, 10) AS date, substr(date_time, 12, 8) AS time FROM roster_ok""")
def local_date_time(spark, d):
    """P10: local date / time by position from offset text."""
    return clean.split_local_datetime(_roster(spark, d).select("sample", "date_time"), "date_time")


@register("exclude_values", f"""
SELECT campaignid, opcode, broad FROM ({V.DOT_POINTS_SQL})
WHERE broad IS NOT NULL AND broad NOT IN ('Unknown', '')""")
def exclude_values(spark, d):
    """Drop Unknown / missing / blank."""
    return clean.exclude_values(V.dot_points(spark, d).select("campaignid", "opcode", "broad"),
                                "broad", ["Unknown", None, ""])


@register("exclude_sample", _with(ROSTER_OK) + """
SELECT sample, site FROM roster_ok WHERE sample <> 7""")
def exclude_sample(spark, d):
    """Drop one named deployment."""
    return clean.exclude_value(_roster(spark, d).select("sample", "site"), "sample", 7)


@register("complete_cases", f"""
SELECT * FROM ({V.BENTHOS_SQL}) WHERE number IS NOT NULL AND level_2 IS NOT NULL""")
def complete_cases(spark, d):
    """Complete rows for given columns."""
    return clean.complete_cases(V.benthos(spark, d), ["number", "level_2"])


@register("strict_thresholds", _with(("lm", f"""SELECT family, genus, species, avg(m) AS lm FROM (
      SELECT family, genus, species, sex, min(l50_mm) AS m FROM ({V.MATURITY_SQL})
      WHERE l50_mm IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")) + f"""
SELECT l.sample, l.family, l.genus, l.species, ROUND(l.length_mm, 6) AS length_mm, l.number, ROUND(m.lm, 6) AS lm
FROM ({V.LENGTHS_SQL}) l JOIN lm m ON l.family = m.family AND l.genus = m.genus AND l.species = m.species
WHERE l.length_mm > 280 AND l.length_mm > m.lm""")
def strict_thresholds(spark, d):
    """Strict > against a constant and against another column."""
    lm = agg.size_at_maturity(V.maturity(spark, d), TAXON)
    ln = joins.natural_join(V.lengths(spark, d).drop("successful_length"), lm, "inner", on=TAXON)
    return fin(clean.strictly_above(clean.strictly_above(ln, "length_mm", 280.0), "length_mm", "lm"))


@register("map_extent", _with(ROSTER_OK) + """
SELECT sample, ROUND(longitude_dd, 6) AS lon, ROUND(latitude_dd, 6) AS lat, 4326 AS geometry_crs FROM roster_ok
WHERE longitude_dd BETWEEN -500 AND 5000 AND latitude_dd BETWEEN 50 AND 300""")
def map_extent(spark, d):
    """P18 + P19: point from lon/lat with CRS, rows inside an extent given
    high-to-low in y."""
    r = clean.with_point(_roster(spark, d), "longitude_dd", "latitude_dd")
    r = clean.within_bbox(r, "longitude_dd", "latitude_dd", (-500, 5000), (300, 50))
    return fin(r.select("sample", F.col("geometry.lon").alias("lon"), F.col("geometry.lat").alias("lat"),
                        "geometry_crs"))


# ==================================================================== joins

@register("mismatch_report", _with(ROSTER_OK, *maxn_ctes()) + """
SELECT sample, 'roster_only' AS side FROM roster_ok r WHERE NOT EXISTS (SELECT 1 FROM maxn m WHERE m.sample = r.sample)
UNION ALL
SELECT DISTINCT sample, 'counts_only' AS side FROM maxn m WHERE NOT EXISTS (SELECT 1 FROM roster_ok r WHERE m.sample = r.sample)""")
def mismatch_report(spark, d):
    """Two-way anti join between the roster and the MaxN table."""
    m = _maxn(spark, d).select("sample").distinct()
    return joins.mismatch_report(_roster(spark, d).select("sample"), m, on=["sample"],
                                 names=("roster", "counts"))


@register("zero_fill_grid", _with(ROSTER_OK, *maxn_ctes(), ("g", """
    SELECT sample, genus, CAST(sum(count) AS BIGINT) AS count FROM maxn GROUP BY 1, 2"""),
    ("lv", "SELECT DISTINCT genus FROM g")) + """
SELECT r.sample, r.site, lv.genus, coalesce(g.count, 0) AS count
FROM roster_ok r JOIN lv ON TRUE LEFT JOIN g ON g.sample = r.sample AND g.genus IS NOT DISTINCT FROM lv.genus""")
def zero_fill_grid(spark, d):
    """Summed MaxN per genus for every deployment x genus, zeros filled."""
    g = agg.sum_counts(_maxn(spark, d), ["sample", "genus"])
    r = _roster(spark, d).select("sample", "site")
    return joins.zero_fill_grid(g, r, ["sample"], ["genus"], ["count"])


@register("natural_left_join", _with(ROSTER_OK, RELIEF_SUM) + """
SELECT r.sample, r.site, ROUND(s.mean_relief, 6) AS mean_relief, ROUND(s.sd_relief, 6) AS sd_relief
FROM roster_ok r LEFT JOIN relief_sum s ON r.sample IS NOT DISTINCT FROM s.sample""")
def natural_left_join(spark, d):
    """Left natural join (shared columns found and used as keys)."""
    r = _roster(spark, d).select("sample", "site")
    return fin(joins.natural_join(r, P.relief_summary(V.relief(spark, d)), "left"))


# ============================================================ aggregations

@register("max_n", _with(*maxn_ctes()) + "SELECT * FROM maxn")
def max_n(spark, d):
    """MaxN per deployment x taxon after filter and relabels."""
    return _maxn(spark, d)


@register("max_n_missing", _with(*maxn_ctes(True)) + "SELECT * FROM maxn")
def max_n_missing(spark, d):
    """A1 with R's NA rule: one missing count makes MaxN missing (T5)."""
    return _maxn(spark, d, with_missing=True)


@register("top_species", _with(*maxn_ctes()) + """
SELECT scientific, CAST(sum(count) AS BIGINT) AS sum_maxn FROM maxn GROUP BY 1""")
def top_species(spark, d):
    """A3: overall sum of MaxN per taxon, sorted ascending."""
    return agg.top_species(_maxn(spark, d))


@register("top_species_10", _with(*maxn_ctes()) + """
SELECT scientific, CAST(sum(count) AS BIGINT) AS sum_maxn FROM maxn GROUP BY 1
ORDER BY sum_maxn DESC, scientific LIMIT 10""")
def top_species_10(spark, d):
    """A3 as a top-k report (the limit is the feature)."""
    return agg.top_species(_maxn(spark, d), n=10, ascending=False)


@register("weighted_tally", _with(CLASSIFIED) + """
SELECT sample, habitat, CAST(coalesce(sum(number), 0) AS BIGINT) AS number FROM classified GROUP BY 1, 2""")
def weighted_tally(spark, d):
    """A4: tally(wt) per deployment x class."""
    b = clean.classify(V.benthos(spark, d), V.HABITAT_RULES, "habitat")
    return agg.weighted_tally(b, ["sample", "habitat"], "number", out="number")


@register("point_count", f"""
SELECT campaignid, opcode, broad, count(*) AS number FROM ({V.DOT_POINTS_SQL})
WHERE broad IS NOT NULL AND broad NOT IN ('Unknown', '') GROUP BY 1, 2, 3""")
def point_count(spark, d):
    """A5: unit weight then sum = points per class."""
    p = clean.exclude_values(V.dot_points(spark, d), "broad", ["Unknown", None, ""])
    return agg.point_count(p, ["campaignid", "opcode", "broad"])


@register("relief_moments", _with(RELIEF_SUM) + """
SELECT sample, ROUND(mean_relief, 6) AS mean_relief, ROUND(sd_relief, 6) AS sd_relief FROM relief_sum""")
def relief_moments(spark, d):
    """Weighted mean and sd without replicating rows."""
    return fin(P.relief_summary(V.relief(spark, d)))


@register("uncount_mean_sd", f"""
SELECT sample, ROUND(CASE WHEN count(x) = count(*) THEN avg(x) END, 6) AS mean_relief,
       ROUND(stddev_samp(x), 6) AS sd_relief
FROM (SELECT sample, TRY_CAST(level_5 AS DOUBLE) AS x FROM ({V.RELIEF_SQL}) r, range(r.number) t(i))
GROUP BY sample""")
def uncount_mean_sd(spark, d):
    """A7 + A8: replicate rows by weight, then plain mean and sd(na.rm)."""
    u = agg.uncount(V.relief(spark, d), "number").withColumn("x", F.col("level_5").try_cast("double"))
    res = u.groupBy("sample").agg(
        F.when(F.count("x") == F.count(F.lit(1)), F.avg("x")).alias("mean_relief"),
        F.stddev_samp("x").alias("sd_relief"))
    return fin(res)


@register("size_at_maturity", f"""
SELECT family, genus, species, ROUND(avg(m), 6) AS lm FROM (
  SELECT family, genus, species, sex, min(l50_mm) AS m FROM ({V.MATURITY_SQL})
  WHERE l50_mm IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def size_at_maturity(spark, d):
    """Lowest L50 per taxon x sex, mean over sexes."""
    return fin(agg.size_at_maturity(V.maturity(spark, d), TAXON))


@register("first_by_min", f"""
SELECT family, genus, species, sex, ROUND(l50_mm, 6) AS l50_mm, row_id FROM (
  SELECT *, row_number() OVER (PARTITION BY family, genus, species, sex ORDER BY l50_mm, row_id) AS rn
  FROM ({V.MATURITY_SQL}) WHERE l50_mm IS NOT NULL) WHERE rn = 1""")
def first_by_min(spark, d):
    """Whole row with the minimum per group, ties by row id."""
    return fin(rank.first_by_min(V.maturity(spark, d), TAXON + ["sex"], "l50_mm", ["row_id"]))


ABUND_SQL = """
SELECT sample, 'total_abundance' AS response, CAST(coalesce(sum(count), 0) AS DOUBLE) AS number FROM maxn GROUP BY 1
UNION ALL
SELECT sample, 'species_richness' AS response, CAST(sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) AS DOUBLE) AS number
FROM maxn GROUP BY 1"""


@register("abundance_richness", _with(*maxn_ctes()) + ABUND_SQL)
def abundance_richness(spark, d):
    """C4 / A10: total abundance and species richness, long, no pivot."""
    return P.abundance_long(_maxn(spark, d))


@register("abundance_richness_skip3", _with(*maxn_ctes(), ("first3", """
    SELECT scientific FROM (SELECT scientific, row_number() OVER (ORDER BY sample, family, genus, species) AS rn
    FROM maxn) GROUP BY scientific ORDER BY min(rn) LIMIT 3"""), ("maxn2", """
    SELECT sample, CASE WHEN scientific IN (SELECT scientific FROM first3) THEN NULL ELSE count END AS count
    FROM maxn""")) + ABUND_SQL.replace("FROM maxn", "FROM maxn2"))
def abundance_richness_skip3(spark, d):
    """A10 literal mode: the first three taxa (first-appearance order)
    left out, as the reference's column offset does (T10)."""
    return P.abundance_long(_maxn(spark, d), skip_first=3, order_cols=["sample", *TAXON])


@register("size_class_abundance", _with(("lm", f"""SELECT family, genus, species, avg(m) AS lm FROM (
      SELECT family, genus, species, sex, min(l50_mm) AS m FROM ({V.MATURITY_SQL})
      WHERE l50_mm IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""),
    ("ln", f"""SELECT l.*, m.lm, coalesce(l.genus,'NA') || ' ' || coalesce(l.species,'NA') AS scientific
      FROM ({V.LENGTHS_SQL}) l LEFT JOIN lm m ON l.family IS NOT DISTINCT FROM m.family
      AND l.genus IS NOT DISTINCT FROM m.genus AND l.species IS NOT DISTINCT FROM m.species
      WHERE l.successful_length = 'Yes'"""),
    ("roster_l", "SELECT DISTINCT sample FROM ln"),
    ("a", f"""SELECT sample,
      sum(CASE WHEN length_mm > lm THEN number END) AS c0, sum(CASE WHEN length_mm < lm THEN number END) AS c1,
      sum(CASE WHEN length_mm > 280 THEN number END) AS c2, sum(CASE WHEN length_mm < 280 THEN number END) AS c3
      FROM ln WHERE scientific = '{V.FOCAL_LABEL}' GROUP BY sample"""),
    ("f", """SELECT r.sample, CAST(coalesce(a.c0, 0) AS BIGINT) AS c0, CAST(coalesce(a.c1, 0) AS BIGINT) AS c1,
      CAST(coalesce(a.c2, 0) AS BIGINT) AS c2, CAST(coalesce(a.c3, 0) AS BIGINT) AS c3
      FROM roster_l r LEFT JOIN a ON a.sample = r.sample""")) + """
SELECT sample, 'Mature BR' AS response, c0 AS number FROM f UNION ALL
SELECT sample, 'Immature BR', c1 FROM f UNION ALL
SELECT sample, 'Legal BR', c2 FROM f UNION ALL
SELECT sample, 'Sublegal BR', c3 FROM f""")
def size_class_abundance(spark, d):
    """Four size classes of one taxon in one pass, zero-filled."""
    return P.size_class_table(V.lengths(spark, d), V.maturity(spark, d), V.FOCAL_LABEL,
                              legal_mm=V.LEGAL_MM, suffix="BR")


@register("size_class_roster", f"""WITH sc AS (""" + QUERIES["size_class_abundance"][1] + f"""),
r AS (SELECT DISTINCT sample, successful_length FROM ({V.LENGTHS_SQL}) WHERE successful_length = 'Yes')
SELECT sc.sample, r.successful_length, sc.response, sc.number FROM sc JOIN r ON sc.sample = r.sample""")
def size_class_roster(spark, d):
    """C11: size classes zero-filled over a roster that keeps its columns."""
    return P.size_class_table(V.lengths(spark, d), V.maturity(spark, d), V.FOCAL_LABEL, legal_mm=V.LEGAL_MM,
                              roster_cols=("sample", "successful_length"), suffix="BR")


@register("distinct_roster", f"""SELECT DISTINCT sample, successful_length FROM ({V.LENGTHS_SQL})""")
def distinct_roster(spark, d):
    """Distinct deployments of a table."""
    return agg.distinct_rows(V.lengths(spark, d), ["sample", "successful_length"])


@register("audit_taxa", _with(*maxn_ctes()) + """
SELECT count(*) AS n_rows,
  CAST(count(DISTINCT scientific) + max(CASE WHEN scientific IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_distinct,
  CAST(sum(CASE WHEN scientific IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing
FROM maxn""")
def audit_taxa(spark, d):
    """Rows, distinct labels (NA counted), missing labels, one pass."""
    return agg.audit(_maxn(spark, d), "scientific")


def _describe_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", ROUND(min({c}), 6) AS min,
  ROUND(quantile_cont({c}, 0.25), 6) AS q1, ROUND(quantile_cont({c}, 0.5), 6) AS median,
  ROUND(avg({c}), 6) AS mean, ROUND(quantile_cont({c}, 0.75), 6) AS q3, ROUND(max({c}), 6) AS max,
  CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM {src}""")
    return "\nUNION ALL\n".join(parts)


@register("describe_habitat", _with(*HABITAT_CTES) + _describe_sql(
    "habitat", ["depth_m", "sand", "posidonia", "turf", "mean_relief"]))
def describe_habitat(spark, d):
    """R summary() of model covariates (type-7 quartiles)."""
    return fin(agg.describe_num(_habitat(spark, d), ["depth_m", "sand", "posidonia", "turf", "mean_relief"]))


@register("correlation", _with(*HABITAT_CTES) + """
SELECT ROUND(CASE WHEN count(sand) = count(*) AND count(depth_m) = count(*) THEN corr(sand, depth_m) END, 6) AS r_na,
       ROUND(corr(CASE WHEN sand IS NOT NULL AND mean_relief IS NOT NULL THEN sand END,
                  CASE WHEN sand IS NOT NULL AND mean_relief IS NOT NULL THEN mean_relief END), 6) AS r_complete
FROM habitat""")
def correlation(spark, d):
    """Pearson r with R's NA rule and with complete cases."""
    from abundance.functions.columns import na_corr
    h = _habitat(spark, d)
    return fin(h.agg(na_corr("sand", "depth_m").alias("r_na"),
                     na_corr("sand", "mean_relief", na_rm=True).alias("r_complete")))


CORR_COLS = ["depth_m", "sand", "posidonia", "turf", "mean_relief", "sd_relief"]
CORR_CASES = ("cc", "SELECT * FROM habitat WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in CORR_COLS))


def _corr_sql(cols, where=""):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"""SELECT '{a}' AS var1, '{b}' AS var2,
  ROUND(CASE WHEN count({a}) = count(*) AND count({b}) = count(*) THEN corr({a}, {b}) END, 6) AS r FROM cc""")
    return "\nUNION ALL\n".join(parts)


@register("corr_matrix", _with(*HABITAT_CTES, CORR_CASES)
          + _corr_sql(CORR_COLS))
def corr_matrix(spark, d):
    """Pairwise correlations of predictors over complete cases, one pass."""
    h = clean.complete_cases(_habitat(spark, d), CORR_COLS)
    return fin(agg.corr_matrix(h, CORR_COLS))


@register("collinear_pairs", _with(*HABITAT_CTES, CORR_CASES)
          + "SELECT * FROM (" + _corr_sql(CORR_COLS) + ") WHERE abs(r) > 0.28")
def collinear_pairs(spark, d):
    """Predictor pairs above the cutoff (|r| > 0.28)."""
    h = clean.complete_cases(_habitat(spark, d), CORR_COLS)
    return fin(agg.collinear_pairs(h, CORR_COLS, cutoff=0.28))


@register("zero_fraction", "WITH sc AS (" + QUERIES["size_class_abundance"][1] + """)
SELECT response, ROUND(sum(CASE WHEN number = 0 THEN 1 ELSE 0 END) / count(*), 6) AS zero_fraction
FROM sc GROUP BY response""")
def zero_fraction(spark, d):
    """Share of zeros per size-class response, all shares."""
    t = size_class_abundance(spark, d)
    return fin(agg.zero_fraction(t, "response", "number", threshold=None))


@register("zero_screen", "WITH sc AS (" + QUERIES["size_class_abundance"][1] + "), " + _with(*maxn_ctes()).removeprefix("WITH ") + """
SELECT response, ROUND(sum(CASE WHEN number = 0 THEN 1 ELSE 0 END) / count(*), 6) AS zero_fraction
FROM (SELECT response, CAST(number AS DOUBLE) AS number FROM sc UNION ALL
      SELECT 'total_abundance', CAST(coalesce(sum(count), 0) AS DOUBLE) FROM maxn GROUP BY sample)
GROUP BY response HAVING sum(CASE WHEN number = 0 THEN 1 ELSE 0 END) / count(*) < 0.95""")
def zero_screen(spark, d):
    """Responses that pass the screen of fewer than 95 % zeros."""
    sizes = size_class_abundance(spark, d).select("response", F.col("number").cast("double").alias("number"))
    total = agg.sum_counts(_maxn(spark, d), ["sample"], out="number").select(
        F.lit("total_abundance").alias("response"), F.coalesce("number", F.lit(0)).cast("double").alias("number"))
    return fin(agg.zero_fraction(reshape.stack_tables(sizes, total), "response", "number", threshold=0.95))


@register("mean_se_by_site", _with(ROSTER_OK, *maxn_ctes(), ("ab", """
    SELECT r.sample, r.site, coalesce(t.n, 0) AS number FROM roster_ok r
    LEFT JOIN (SELECT sample, sum(count) AS n FROM maxn GROUP BY 1) t ON t.sample = r.sample""")) + """
SELECT site, ROUND(avg(number), 6) AS mean, ROUND(stddev_samp(number) / sqrt(count(number)), 6) AS se,
  ROUND(avg(number) - stddev_samp(number) / sqrt(count(number)), 6) AS ymin,
  ROUND(avg(number) + stddev_samp(number) / sqrt(count(number)), 6) AS ymax
FROM ab GROUP BY site""")
def mean_se_by_site(spark, d):
    """Mean +/- se of total abundance (true zeros) per site."""
    t = agg.sum_counts(_maxn(spark, d), ["sample"], out="number")
    z = joins.zero_fill(t, _roster(spark, d).select("sample", "site"), ["sample"], ["number"])
    return fin(agg.mean_se(z, ["site"], "number"))


@register("lm_line", _with(*HABITAT_CTES) + """
SELECT ROUND(regr_slope(turf, sand), 6) AS slope, ROUND(regr_intercept(turf, sand), 6) AS intercept,
       CAST(regr_count(turf, sand) AS BIGINT) AS n FROM habitat WHERE sand IS NOT NULL AND turf IS NOT NULL""")
def lm_line(spark, d):
    """Least-squares line (the data of geom_smooth(method='lm'))."""
    f = agg.lm_fit(_habitat(spark, d), "sand", "turf")
    return fin(f.select("slope", "intercept", "n"))


# ============================================================== windows

@register("group_total", _with(CLASSIFIED, ("t", """
    SELECT sample, habitat, CAST(coalesce(sum(number), 0) AS BIGINT) AS number FROM classified GROUP BY 1, 2""")) + """
SELECT sample, habitat, number, CAST(sum(number) OVER (PARTITION BY sample) AS BIGINT) AS total_points_annotated FROM t""")
def group_total(spark, d):
    """Tally then the deployment total on every class row."""
    b = clean.classify(V.benthos(spark, d), V.HABITAT_RULES, "habitat")
    t = agg.weighted_tally(b, ["sample", "habitat"], "number", out="number")
    return rank.group_total(t, ["sample"], "number", "total_points_annotated")


MODELS_SQL = ("models", f"""SELECT campaignid AS response, successful_length || '+' || site AS modname,
    avg(depth_m) / 1000.0 AS aicc FROM ({V.ROSTER_SQL}) GROUP BY 1, 2""")


@register("model_report", _with(MODELS_SQL) + """
SELECT response, modname, ROUND(aicc, 6) AS aicc, ROUND(delta_aicc, 6) AS delta_aicc, ROUND(wi_aicc, 6) AS wi_aicc,
  ROUND(sum(wi_aicc) OVER (PARTITION BY response ORDER BY aicc, modname ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumsum_wi
FROM (SELECT *, exp(-delta_aicc / 2) / sum(exp(-delta_aicc / 2)) OVER (PARTITION BY response) AS wi_aicc
      FROM (SELECT *, aicc - min(aicc) OVER (PARTITION BY response) AS delta_aicc FROM models))
QUALIFY delta_aicc <= 10""")
def model_report(spark, d):
    """C15 / W3-W5 / O1 on a table shaped like a model-selection table
    (response x model, AICc): delta, weights, cumulative weight, cut."""
    r = V.roster(spark, d)
    models = r.groupBy(F.col("campaignid").alias("response"),
                       F.concat_ws("+", "successful_length", "site").alias("modname")).agg(
        (F.avg("depth_m") / 1000.0).alias("aicc"))
    return fin(P.model_report(models))


@register("category_order", _with(*maxn_ctes()) + """
SELECT scientific, CAST(sum(count) AS BIGINT) AS sum_maxn,
  CAST(row_number() OVER (ORDER BY sum(count), scientific) AS INTEGER) AS "order" FROM maxn GROUP BY 1""")
def category_order(spark, d):
    """O1: category order of taxa by overall abundance (reorder)."""
    return rank.category_order(agg.top_species(_maxn(spark, d)), "scientific", "sum_maxn")


# ============================================================== reshape

@register("widen_habitat", _with(CLASSIFIED, ("t", """
    SELECT sample, coalesce(habitat, 'unclassified') AS habitat, CAST(coalesce(sum(number), 0) AS BIGINT) AS number,
    count(*) AS n FROM classified GROUP BY 1, 2""")) + """
SELECT sample,
  coalesce(max(CASE WHEN habitat = 'posidonia' THEN number END), 0) AS posidonia,
  coalesce(max(CASE WHEN habitat = 'sand' THEN number END), 0) AS sand,
  coalesce(max(CASE WHEN habitat = 'turf' THEN number END), 0) AS turf,
  coalesce(max(CASE WHEN habitat = 'unclassified' THEN number END), 0) AS unclassified
FROM t GROUP BY sample""")
def widen_habitat(spark, d):
    """Long tally -> wide, absent cells 0, NULL class named."""
    b = clean.classify(V.benthos(spark, d), V.HABITAT_RULES, "habitat")
    t = agg.weighted_tally(b, ["sample", "habitat"], "number", out="number")
    return reshape.widen(t, ["sample"], "habitat", "number", fill=0,
                         levels=["posidonia", "sand", "turf", None])


@register("lengthen_habitat", _with(*HABITAT_CTES) + """
SELECT sample, 'posidonia' AS habitat, ROUND(posidonia, 6) AS percentage FROM habitat UNION ALL
SELECT sample, 'sand', ROUND(sand, 6) FROM habitat UNION ALL
SELECT sample, 'turf', ROUND(turf, 6) FROM habitat""")
def lengthen_habitat(spark, d):
    """R2: wide cover -> long (NULL values kept)."""
    h = _habitat(spark, d)
    return fin(reshape.lengthen(h.select("sample", *V.HABITAT_CLASSES), ids=["sample"],
                                names_to="habitat", values_to="percentage"))


@register("stack_tables", _with(ROSTER_OK, RELIEF_SUM) + """
SELECT sample, site, NULL::DOUBLE AS mean_relief, 'roster' AS source FROM roster_ok UNION ALL
SELECT sample, NULL::VARCHAR AS site, ROUND(mean_relief, 6) AS mean_relief, 'relief' AS source FROM relief_sum""")
def stack_tables(spark, d):
    """U1 + U2: bind_rows by name (missing -> NULL), named-list stack."""
    r = _roster(spark, d).select("sample", "site")
    s = P.relief_summary(V.relief(spark, d)).select("sample", "mean_relief")
    return fin(reshape.stack_named({"roster": r, "relief": s}, names_to="source"))


# ============================================================ composites

@register("habitat_cover", _with(*HABITAT_CTES) + """
SELECT sample, site, ROUND(depth_m, 6) AS depth_m, date_time, total_points_annotated,
  ROUND(posidonia, 6) AS posidonia, ROUND(sand, 6) AS sand, ROUND(turf, 6) AS turf,
  ROUND(mean_relief, 6) AS mean_relief, ROUND(sd_relief, 6) AS sd_relief
FROM habitat""")
def habitat_cover(spark, d):
    """Percent cover per class + relief summary, left-joined to the
    roster; deployments without benthos keep NULL cover (T9)."""
    return fin(_habitat(spark, d))


@register("benthos_composition", _with(CLASSIFIED, COMPOSITION) + """
SELECT sample, total_points_annotated, unclassified, 'posidonia' AS habitat, posidonia AS number FROM composition UNION ALL
SELECT sample, total_points_annotated, unclassified, 'sand', sand FROM composition UNION ALL
SELECT sample, total_points_annotated, unclassified, 'turf', turf FROM composition""")
def benthos_composition(spark, d):
    """Classes per deployment (absent 0) with total incl. unclassified."""
    return P.benthos_composition(V.benthos(spark, d), V.HABITAT_RULES, V.HABITAT_CLASSES)


@register("model_frame", _with(*HABITAT_CTES, *maxn_ctes(), ("ab", """
    SELECT sample, CAST(coalesce(sum(count), 0) AS DOUBLE) AS number FROM maxn GROUP BY 1""")) + """
SELECT a.sample, 'total_abundance' AS response, a.number, h.site, ROUND(h.depth_m, 6) AS depth_m, h.date_time,
  h.total_points_annotated, ROUND(h.posidonia, 6) AS posidonia, ROUND(h.sand, 6) AS sand, ROUND(h.turf, 6) AS turf,
  ROUND(h.mean_relief, 6) AS mean_relief, ROUND(h.sd_relief, 6) AS sd_relief,
  substr(h.date_time, 1, 10) AS date, substr(h.date_time, 12, 8) AS time
FROM ab a LEFT JOIN habitat h ON a.sample = h.sample WHERE a.sample <> 7""")
def model_frame(spark, d):
    """Total abundance + habitat + local date/time, one deployment
    dropped by name."""
    ab = P.abundance_long(_maxn(spark, d))
    return fin(P.model_frame(ab, _habitat(spark, d), drop_sample=7))


@register("dot_point_habitat", _with(("pts", V.DOT_POINTS_SQL), ("h", """SELECT campaignid, opcode,
    count(*) FILTER (WHERE broad = 'Economy') AS economy, count(*) FILTER (WHERE broad = 'Promo') AS promo,
    count(*) FILTER (WHERE broad = 'Standard') AS standard
    FROM pts WHERE broad IS NOT NULL AND broad NOT IN ('Unknown', '') GROUP BY 1, 2"""),
    ("r", """SELECT campaignid, opcode, CASE WHEN count(x) = count(*) THEN avg(x) END AS mean_relief,
    CASE WHEN count(x) = count(*) THEN stddev_samp(x) END AS sd_relief
    FROM (SELECT campaignid, opcode, TRY_CAST(level_5 AS DOUBLE) AS x FROM pts
          WHERE level_5 IS NOT NULL AND level_5 <> '') GROUP BY 1, 2""")) + """
SELECT h.campaignid, h.opcode, h.economy, h.promo, h.standard, h.economy + h.promo + h.standard AS total_points_annotated,
  ROUND(r.mean_relief, 6) AS mean_relief, ROUND(r.sd_relief, 6) AS sd_relief
FROM h LEFT JOIN r ON h.campaignid = r.campaignid AND h.opcode = r.opcode""")
def dot_point_habitat(spark, d):
    """Points per class (Unknown/NA/blank dropped), wide, clean names,
    row total; relief mean/sd joined."""
    pts = V.dot_points(spark, d)
    hab = P.dot_point_habitat(pts)
    rel = P.dot_point_relief(pts)
    return fin(joins.natural_join(hab, rel, "left"))


@register("single_species_response", _with(*maxn_ctes()) + f"""
SELECT *, 'Abundance of BR' AS response FROM maxn WHERE genus || ' ' || species = '{V.FOCAL_LABEL}'""")
def single_species_response(spark, d):
    """One taxon's MaxN rows with a response label."""
    m = _maxn(spark, d).withColumn("__l", taxon_label("genus", "species"))
    return P.single_species_response(m, V.FOCAL_LABEL, "Abundance of BR", taxon="__l").drop("__l")


# ================================================================ charts

def _depth(spark, d):
    return _roster(spark, d).select("sample", "site", "depth_m")


@register("hist_30", _with(ROSTER_OK, ("st", """SELECT min(depth_m) AS lo, (max(depth_m) - min(depth_m)) / 29 AS width
    FROM roster_ok"""), ("b", """SELECT CAST(greatest(ceil((depth_m - (lo - width / 2) - 1e-7 * width) / width), 1) AS INTEGER) AS bin
    FROM roster_ok, st WHERE depth_m IS NOT NULL"""), ("g", """SELECT CAST(i AS INTEGER) AS bin,
    (lo - width / 2) + (i - 1) * width AS lower, (lo - width / 2) + i * width AS upper FROM st, range(1, 31) t(i)""")) + """
SELECT g.bin, ROUND(g.lower, 6) AS lower, ROUND(g.upper, 6) AS upper, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM g LEFT JOIN (SELECT bin, count(*) AS n FROM b GROUP BY bin) c ON c.bin = g.bin""")
def hist_30(spark, d):
    """V1: ggplot-style 30-bin histogram of depth (right-closed, empty bins kept)."""
    from abundance.operators.charts import hist_bins
    return fin(hist_bins(_depth(spark, d), "depth_m", bins=30))


@register("hist_sturges", _with(ROSTER_OK, *maxn_ctes(), ("v", "SELECT sum(count) AS x FROM maxn GROUP BY sample"),
    ("st", """SELECT CAST(min(x) AS DOUBLE) AS lo, CAST(max(x) AS DOUBLE) AS hi, (max(x) - min(x)) / ceil(log2(count(x)) + 1) AS cell FROM v"""),
    ("pw", "SELECT *, pow(10, floor(log10(cell))) AS ten FROM st"),
    ("un", """SELECT *, ten * CASE WHEN cell > 7 * ten THEN 10 WHEN cell > 2.8 * ten THEN 5 WHEN cell > 1.4 * ten THEN 2 ELSE 1 END AS width FROM pw"""),
    ("br", """SELECT *, floor(lo / width + 1e-7) * width AS start, CAST(ceil(hi / width - 1e-7) - floor(lo / width + 1e-7) AS BIGINT) AS nb FROM un"""),
    ("b", """SELECT CAST(greatest(ceil((x - start - 1e-7 * width) / width), 1) AS INTEGER) AS bin FROM v, br WHERE x IS NOT NULL""")) + """
SELECT CAST(i AS INTEGER) AS bin, ROUND(start + (i - 1) * width, 6) AS lower, ROUND(start + i * width, 6) AS upper,
  CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM br, range(1, 1000) t(i) LEFT JOIN (SELECT bin, count(*) AS n FROM b GROUP BY bin) c ON c.bin = i WHERE i <= nb""")
def hist_sturges(spark, d):
    """V1: R hist() bins (Sturges count, pretty breaks) of total abundance."""
    from abundance.operators.charts import hist_bins
    t = agg.sum_counts(_maxn(spark, d), ["sample"], out="number")
    return fin(hist_bins(t, "number"))


@register("rescale_sand", _with(*HABITAT_CTES) + """
SELECT sample, ROUND(sand, 6) AS sand,
  ROUND((sand - min(sand) OVER ()) / (max(sand) OVER () - min(sand) OVER ()), 6) AS sand_pos FROM habitat""")
def rescale_sand(spark, d):
    """V2: value -> palette position in [0, 1] over the domain."""
    from abundance.operators.charts import rescale
    return fin(rescale(_habitat(spark, d).select("sample", "sand"), "sand"))


@register("map_points", _with(ROSTER_OK, *maxn_ctes(), ("ab", """SELECT r.sample, r.longitude_dd, r.latitude_dd,
    CAST(coalesce(t.n, 0) AS BIGINT) AS value FROM roster_ok r
    LEFT JOIN (SELECT sample, sum(count) AS n FROM maxn GROUP BY 1) t ON t.sample = r.sample""")) + """
SELECT ROUND(longitude_dd, 6) AS lon, ROUND(latitude_dd, 6) AS lat, value, ROUND(value / 5.0, 6) AS radius,
  CAST(sample AS VARCHAR) AS label,
  ROUND((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 6) AS colour FROM ab""")
def map_points(spark, d):
    """V3: circle-marker layer of total abundance (true zeros)."""
    from abundance.operators.charts import map_points as mp
    t = agg.sum_counts(_maxn(spark, d), ["sample"], out="value")
    z = joins.zero_fill(t, _roster(spark, d).select("sample", "longitude_dd", "latitude_dd"), ["sample"], ["value"])
    return fin(mp(z, "longitude_dd", "latitude_dd", "value", "sample"))


@register("composition_shares", _with(CLASSIFIED, COMPOSITION, ("lng", """
    SELECT sample, 'posidonia' AS habitat, posidonia AS number FROM composition UNION ALL
    SELECT sample, 'sand', sand FROM composition UNION ALL SELECT sample, 'turf', turf FROM composition""")) + """
SELECT sample, habitat, number, ROUND(number / nullif(sum(number) OVER (PARTITION BY sample), 0), 6) AS share FROM lng""")
def composition_shares(spark, d):
    """V4: class shares per deployment (pie data) from the long composition."""
    from abundance.operators.charts import composition_shares as cs
    comp = P.benthos_composition(V.benthos(spark, d), V.HABITAT_RULES, V.HABITAT_CLASSES)
    return fin(cs(comp.select("sample", "habitat", "number"), ["sample"], "habitat", "number"))


@register("scatter_points", _with(*HABITAT_CTES) + """
SELECT ROUND(turf, 6) AS turf, ROUND(depth_m, 6) AS depth_m FROM habitat WHERE turf IS NOT NULL AND depth_m IS NOT NULL""")
def scatter_points(spark, d):
    """V5: two columns for a scatter plot (whole table, no sampling)."""
    from abundance.operators.charts import scatter_points as sp
    return fin(sp(_habitat(spark, d), "turf", "depth_m"))


# ================================================================ models

def _frame(spark, d):
    """Model frame (C8) with true zeros: total abundance per successful
    deployment + habitat covariates. The habitat table already has one row
    per roster deployment, so the summed MaxN joins it directly and absent
    deployments get 0 (one roster scan, not two)."""
    t = agg.sum_counts(_maxn(spark, d), ["sample"], out="number")
    fr = joins.natural_join(_habitat(spark, d), t, "left", on=["sample"])
    return clean.fill_missing(fr, ["number"], 0)


GLM_SITE_SQL = _with(ROSTER_OK, *maxn_ctes(), ("ab", """SELECT r.sample, r.site, CAST(coalesce(t.n, 0) AS DOUBLE) AS y
    FROM roster_ok r LEFT JOIN (SELECT sample, sum(count) AS n FROM maxn GROUP BY 1) t ON t.sample = r.sample
    WHERE r.site IS NOT NULL"""), ("g", "SELECT site, avg(y) AS m, sum(y) AS s FROM ab GROUP BY site"),
    ("ref", "SELECT * FROM g ORDER BY site LIMIT 1")) + """
SELECT '(Intercept)' AS term, ROUND(ln(ref.m), 4) AS estimate, ROUND(1 / sqrt(ref.s), 4) AS se FROM ref
UNION ALL
SELECT 'site' || g.site, ROUND(ln(g.m / ref.m), 4), ROUND(sqrt(1 / g.s + 1 / ref.s), 4) FROM g, ref WHERE g.site <> ref.site"""


@register("glm_site", GLM_SITE_SQL)
def glm_site(spark, d):
    """M1: Poisson GLM number ~ site (factor, alphabetical reference);
    closed form: intercept ln mean(ref), coefficients ln mean ratios."""
    from abundance.models.glm import glm
    f = glm(_frame(spark, d), "number", ["site"])
    rows = [(t, round(b, 4), round(s, 4)) for t, b, s, _z, _p in f.table()]
    return spark.createDataFrame(rows, "term string, estimate double, se double")


FRAME = ("frame", """SELECT h.*, coalesce(t.n, 0) AS number FROM habitat h
    LEFT JOIN (SELECT sample, sum(count) AS n FROM maxn GROUP BY 1) t ON t.sample = h.sample""")
SITES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]       # the table's market segments
SITE_X = [f"CASE WHEN site = '{s}' THEN 1.0 ELSE 0.0 END + CASE WHEN site IS NULL THEN NULL ELSE 0.0 END" for s in SITES[1:]]
MODEL_TERMS = {
    "glm0": (["1.0", *SITE_X], ["(Intercept)", *[f"site{s}" for s in SITES[1:]]]),
    "glm1": (["1.0", "depth_m / 100000.0", *SITE_X], ["(Intercept)", "depth_m", *[f"site{s}" for s in SITES[1:]]]),
    "glm2": (["1.0", "depth_m / 100000.0", "posidonia"], ["(Intercept)", "depth_m", "posidonia"]),
    "glm3": (["1.0", "depth_m / 100000.0", "posidonia", "depth_m / 100000.0 * posidonia"],
             ["(Intercept)", "depth_m", "posidonia", "depth_m:posidonia"]),
}
GLM_MODELS_SQL = _with(*HABITAT_CTES, *maxn_ctes(), FRAME, *[c for m, (xs, _t) in MODEL_TERMS.items() for c in glm_ctes(
    m, "SELECT * FROM frame", "number", xs)]) + "SELECT model, term, estimate, se, z, p, ROUND(aic, 4) AS aic, df, n AS n_used FROM (" + (
    " UNION ALL ".join(coef_rows(m, f"'{m}'", terms) for m, (_x, terms) in MODEL_TERMS.items())) + ")"


@register("glm_models", GLM_MODELS_SQL)
def glm_models(spark, d):
    """M1 + M4 + M5: glm0 site, glm1 depth + site, glm2 depth + posidonia,
    depth * posidonia; coefficient tables and the AIC table."""
    from abundance.models.glm import aic_table, coef_table, glm_set
    fr = _frame(spark, d).withColumn("depth_m", F.col("depth_m") / 100000.0)
    fits = glm_set(fr, "number", {"glm0": ["site"], "glm1": ["depth_m", "site"], "glm2": ["depth_m", "posidonia"], "glm3": ["depth_m*posidonia"]})
    coefs = coef_table(spark, fits, 4)
    aics = aic_table(spark, fits).select("model", F.round("aic", 4).alias("aic"), "df", "n_used")
    return coefs.join(aics, on="model", how="left")


def _zip_rows(name: str, model: str, xs: list[str], terms: list[str]) -> str:
    names = [f"count_{t}" for t in terms] + [f"zero_{t}" for t in terms]
    return " UNION ALL ".join(f"SELECT {model} AS model, '{t}' AS term, ROUND(b{i}, 4) AS estimate, ROUND(s{i}, 4) AS se, "
                              f"-2 * ll + 2 * {len(names)} AS aic FROM {name}_fit" for i, t in enumerate(names))


ZIP_TERMS = {"mod1": (["1.0", "depth_m / 100000.0"], ["(Intercept)", "depth_m"]),
             "mod2": (["1.0", "depth_m / 100000.0", "sand / 100.0"], ["(Intercept)", "depth_m", "sand"]),
             "mod3": (["1.0", "depth_m / 100000.0", "turf / 100.0"], ["(Intercept)", "depth_m", "turf"])}


@register("zip_models", _with(*HABITAT_CTES, *maxn_ctes(), FRAME, *[c for m, (xs, _t) in ZIP_TERMS.items() for c in zip_ctes(
    m, "SELECT * FROM frame", "number", xs)]) + "SELECT model, term, estimate, se, ROUND(aic, 2) AS aic FROM (" + " UNION ALL ".join(
    _zip_rows(m, f"'{m}'", xs, t) for m, (xs, t) in ZIP_TERMS.items()) + ")")
def zip_models(spark, d):
    """M2 + M5: the reference's zero-inflated models: depth; depth + sand;
    depth + turf (reef stand-in); coefficients, se and AIC each."""
    from abundance.models.zip import zip_model
    fr = (_frame(spark, d).withColumn("depth_m", F.col("depth_m") / 100000.0)
          .withColumn("sand", F.col("sand") / 100.0).withColumn("turf", F.col("turf") / 100.0)).cache()
    rows = []
    for name, terms in {"mod1": ["depth_m"], "mod2": ["depth_m", "sand"], "mod3": ["depth_m", "turf"]}.items():
        f = zip_model(fr, "number", terms)
        rows += [(name, t, round(b, 4), round(s, 4), round(float(f.aic), 2)) for t, b, s, _z, _p in f.table()]
    fr.unpersist()
    return spark.createDataFrame(rows, "model string, term string, estimate double, se double, aic double")


@register("zip_depth", _with(*HABITAT_CTES, *maxn_ctes(), FRAME, *zip_ctes("m", "SELECT * FROM frame", "number", ZIP_TERMS["mod2"][0]))
          + "SELECT term, estimate, se, ROUND(aic, 4) AS aic FROM (" + _zip_rows("m", "'m'", *ZIP_TERMS["mod2"]) + ")")
def zip_depth(spark, d):
    """M2: zero-inflated Poisson number ~ depth + sand (both parts)."""
    from abundance.models.zip import zip_model
    fr = _frame(spark, d).withColumn("depth_m", F.col("depth_m") / 100000.0).withColumn("sand", F.col("sand") / 100.0)
    f = zip_model(fr, "number", ["depth_m", "sand"])
    rows = [(t, round(b, 4), round(s, 4), round(float(f.aic), 4)) for t, b, s, _z, _p in f.table()]
    return spark.createDataFrame(rows, "term string, estimate double, se double, aic double")


# Natural cubic spline with three knots (smallest, middle and largest of the
# distinct values): x and one more column.
SPLINE = [("kn", """SELECT min(sand) AS t0, quantile_cont(sand, 0.5) AS t1, max(sand) AS t2 FROM
    (SELECT DISTINCT sand FROM frame WHERE sand IS NOT NULL AND number IS NOT NULL)"""),
    ("sp", "SELECT number, sand, t0, t1, t2 FROM frame, kn")]
SPLINE_X = ("(pow(greatest(sand - t0, 0), 3) - pow(greatest(sand - t2, 0), 3)) / (t2 - t0)"
            " - (pow(greatest(sand - t1, 0), 3) - pow(greatest(sand - t2, 0), 3)) / (t2 - t1)")


@register("spline_prediction", _with(*HABITAT_CTES, *maxn_ctes(), FRAME, *SPLINE, *glm_ctes(
    "m", "SELECT * FROM sp", "number", ["1.0", "sand", SPLINE_X], family="tweedie:1.5", steps=25),
    ("gr", """SELECT DISTINCT CASE WHEN i = 19 THEN hi ELSE lo + i * ((hi - lo) / 19) END AS sand, t0, t1, t2
     FROM (SELECT min(sand) AS lo, max(sand) AS hi FROM frame), kn, range(0, 20) r(i)"""),
    ("gx", f"SELECT sand, {SPLINE_X} AS z FROM gr"),
    ("pr", """SELECT sand, exp(b0 + b1 * sand + b2 * z) AS fit, exp(b0 + b1 * sand + b2 * z) * sqrt(pear / (n - 3) * (
      v0_0 + sand * sand * v1_1 + z * z * v2_2 + 2 * sand * v0_1 + 2 * z * v0_2 + 2 * sand * z * v1_2)) AS se FROM gx, m_fit""")) + """
SELECT ROUND(sand, 4) AS sand, ROUND(fit, 4) AS number, ROUND(fit - se, 4) AS lower, ROUND(fit + se, 4) AS upper FROM pr""")
def spline_prediction(spark, d):
    """M6 + M8 + M9 + A21 + V6: smooth of sand (k = 3 natural spline,
    unpenalised, Tweedie family with variance power 1.5 as the reference's
    tw() family, dispersion from Pearson), 20-point grid, mean and se on the
    response scale."""
    from abundance.models.predict import average_predictions, prediction_grid, predict_se
    from abundance.models.spline import spline_glm
    fr = _frame(spark, d)
    f = spline_glm(fr, "number", ["sand"], family="tweedie:1.5")
    grid = prediction_grid(fr, "sand", 20)
    pred = average_predictions(predict_se(f, grid), ["sand"])
    from abundance.operators.charts import curve_with_se
    return fin(curve_with_se(pred, "sand", fit="number", se="se_fit"), 4)


@register("prediction_grid", _with(*HABITAT_CTES, ("st", "SELECT min(sand) AS lo, max(sand) AS hi FROM habitat")) + """
SELECT DISTINCT ROUND(CASE WHEN i = 19 THEN hi ELSE lo + i * ((hi - lo) / 19) END, 6) AS sand FROM st, range(0, 20) t(i)""")
def prediction_grid_q(spark, d):
    """M8: 20 equally spaced values from min to max."""
    from abundance.models.predict import prediction_grid
    return fin(prediction_grid(_habitat(spark, d), "sand", 20))


@register("full_subsets", None)
def full_subsets_q(spark, d):
    """M7 + M10 + A19 + C15: full-subset selection (k = 3 smooths, Tweedie
    family with power 1.5 as the reference's tw()) for total abundance and
    species richness (responses with < 95 % zeros) over seven predictors, up
    to three at a time; ranked model table (delta <= 10)."""
    ranked = _subsets(spark, d).models
    return fin(ranked.where(F.col("delta_aicc") <= 10).drop("loglik"), 4)


SUBSET_PREDICTORS = ["sand", "turf", "posidonia", "depth_m", "mean_relief", "sd_relief", "total_points_annotated"]


def _subsets(spark, d):
    from abundance.models.select import full_subsets
    ab = P.abundance_long(_maxn(spark, d))
    keep = agg.zero_fraction(ab, "response", "number", threshold=0.95).select("response")
    ab = ab.join(F.broadcast(keep), on="response", how="left_semi")      # <= 2 rows
    fr = joins.natural_join(ab, _habitat(spark, d).drop("site", "date_time"), "left", on=["sample"])
    fr = fr.withColumn("depth_m", F.col("depth_m") / 100000.0)
    return full_subsets(fr, "number", SUBSET_PREDICTORS, response="response", max_size=3, cor_cutoff=0.28, family="tweedie:1.5")


@register("glm_lineitem", _with(*glm_ctes("m", "SELECT l_quantity, l_discount, l_tax FROM lineitem", "l_quantity", ["1.0", "l_discount", "l_tax"]))
          + "SELECT term, estimate, se, ROUND(aic, 2) AS aic FROM (" + coef_rows("m", "'m'", ["(Intercept)", "l_discount", "l_tax"]) + ")")
def glm_lineitem(spark, d):
    """M1 at row scale: Poisson GLM l_quantity ~ l_discount + l_tax over the
    whole line-item table (the survey's timing probe)."""
    from abundance.models.glm import glm
    li = V.table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax")
    f = glm(li, "l_quantity", ["l_discount", "l_tax"])
    rows = [(t, round(b, 4), round(s, 4), round(float(f.aic), 2)) for t, b, s, _z, _p in f.table()]
    return spark.createDataFrame(rows, "term string, estimate double, se double, aic double")


@register("glmm_models", None)
def glmm_models(spark, d):
    """M3 + M4 + M5: random-intercept Poisson GLMMs of total abundance:
    depth | site, depth | month, depth + posidonia | site + month (crossed),
    depth * posidonia | site; fixed effects, random sd and AIC."""
    from abundance.models.glmm import poisson_glmm_set
    fr = (_frame(spark, d).withColumn("depth_m", F.col("depth_m") / 100000.0)
          .withColumn("posidonia", F.col("posidonia") / 100.0)
          .withColumn("month", F.substring("date_time", 1, 7)))
    fr = fr.withColumn("turf", F.col("turf") / 100.0)
    fr = clean.complete_cases(fr, ["depth_m", "posidonia", "site", "month", "turf", "mean_relief"])
    specs = {"remod": (["depth_m"], ["site"]), "remod2": (["depth_m"], ["month"]),
             "remod3": (["turf"], ["site"]), "remod4": (["depth_m", "turf"], ["site"]),
             "remod5": (["depth_m", "posidonia"], ["site"]),
             "remod6": (["depth_m", "posidonia"], ["site", "month"]),
             "remod7": (["depth_m", "posidonia", "mean_relief"], ["site", "month"]),
             "glmer1": (["depth_m*posidonia"], ["site", "month"]),
             "glmer2": (["depth_m*posidonia"], ["site"])}
    rows = []
    for name, f in poisson_glmm_set(fr, "number", specs).items():
        sd = ";".join(f"{k}={v:.4f}" for k, v in f.sigma.items())
        for t, b, s, _z, _p in f.table():
            rows.append((name, t, round(b, 4), round(s, 4), sd, round(float(f.aic), 2), int(f.n_used)))
    return spark.createDataFrame(
        rows, "model string, term string, estimate double, se double, random_sd string, aic double, n_used long")



@register("complete_lengths", f"""
SELECT sample, family,
  CASE WHEN genus = 'Brand#1' AND family = 'ECONOMY' THEN 'Brand#0' ELSE genus END AS genus,
  CASE WHEN species = 'red widget' THEN 'spp' ELSE species END AS species,
  ROUND(length_mm, 6) AS length_mm, number, successful_length,
  coalesce(family,'NA') || ' ' ||
  coalesce(CASE WHEN genus = 'Brand#1' AND family = 'ECONOMY' THEN 'Brand#0' ELSE genus END,'NA') || ' ' ||
  coalesce(CASE WHEN species = 'red widget' THEN 'spp' ELSE species END,'NA') AS scientific
FROM ({V.LENGTHS_SQL}) WHERE successful_length = 'Yes'""")
def complete_lengths(spark, d):
    """Successful length rows, relabelled, with the 3-part label."""
    return fin(P.complete_lengths(V.lengths(spark, d), RULES, TAXON))


@register("qa_report", _with(*HABITAT_CTES, *maxn_ctes(), ("a", "SELECT sample, count(*) AS na FROM roster_ok GROUP BY 1"),
    ("b", "SELECT sample, count(*) AS nb FROM maxn GROUP BY 1"),
    ("j", "SELECT a.na, b.nb FROM a FULL OUTER JOIN b ON a.sample = b.sample")) + """
SELECT 'roster_rows' AS "check", CAST(sum(coalesce(na, 0)) AS BIGINT) AS value FROM j UNION ALL
SELECT 'counts_rows', CAST(sum(coalesce(nb, 0)) AS BIGINT) FROM j UNION ALL
SELECT 'roster_only', CAST(sum(CASE WHEN nb IS NULL THEN na ELSE 0 END) AS BIGINT) FROM j UNION ALL
SELECT 'counts_only', CAST(sum(CASE WHEN na IS NULL THEN nb ELSE 0 END) AS BIGINT) FROM j""")
def qa_report(spark, d):
    """Roster vs MaxN table: row counts and rows without a
    partner on either side."""
    return P.qa_report(_roster(spark, d), _maxn(spark, d), ["sample"], names=("roster", "counts"))


@register("describe_events", _describe_sql("events", ["value"]))
def describe_events(spark, d):
    """A15 on the event table's numeric column (whole table)."""
    return fin(agg.describe_num(V.table(spark, d, "events"), ["value"]))


@register("hist_events", _with(("st", """SELECT min(value) AS lo, (max(value) - min(value)) / 29 AS width FROM events"""),
    ("b", """SELECT CAST(greatest(ceil((value - (lo - width / 2) - 1e-7 * width) / width), 1) AS INTEGER) AS bin
    FROM events, st WHERE value IS NOT NULL"""), ("g", """SELECT CAST(i AS INTEGER) AS bin,
    (lo - width / 2) + (i - 1) * width AS lower, (lo - width / 2) + i * width AS upper FROM st, range(1, 31) t(i)""")) + """
SELECT g.bin, ROUND(g.lower, 6) AS lower, ROUND(g.upper, 6) AS upper, CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM g LEFT JOIN (SELECT bin, count(*) AS n FROM b GROUP BY bin) c ON c.bin = g.bin""")
def hist_events(spark, d):
    """V1 on the event table's value column (30 right-closed bins)."""
    from abundance.operators.charts import hist_bins
    return fin(hist_bins(V.table(spark, d, "events").select("value"), "value", bins=30))


@register("glm_by_response", _with(*HABITAT_CTES, *maxn_ctes(), ("ab", """
    SELECT sample, 'total_abundance' AS response, CAST(coalesce(sum(count), 0) AS DOUBLE) AS number FROM maxn GROUP BY 1
    UNION ALL SELECT sample, 'species_richness', CAST(sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) AS DOUBLE) FROM maxn GROUP BY 1"""),
    *glm_ctes("m", "SELECT a.response, a.number, h.depth_m, h.sand FROM ab a JOIN habitat h ON a.sample = h.sample", "number",
                  ["1.0", "depth_m / 100000.0", "sand / 100.0"], group="response")) + "SELECT model, term, estimate, se, z, p FROM ("
          + coef_rows("m", "g", ["(Intercept)", "depth_m", "sand"]) + ")")
def glm_by_response(spark, d):
    """One Poisson GLM per response (total abundance, species
    richness) ~ depth + sand, every response in the same passes."""
    from abundance.models.glm_groups import glm_by_group
    ab = P.abundance_long(_maxn(spark, d))
    fr = joins.natural_join(ab, _habitat(spark, d), "left", on=["sample"])
    fr = fr.withColumn("depth_m", F.col("depth_m") / 100000.0).withColumn("sand", F.col("sand") / 100.0)
    fits = glm_by_group(fr, "response", "number", ["depth_m", "sand"]).withColumnRenamed("group", "model")
    return fin(fits.select("model", "term", "estimate", "se", "z", "p"), 4)


@register("glm_by_part", _with(*glm_ctes("m", "SELECT l_partkey, l_quantity, l_discount, l_tax FROM lineitem", "l_quantity",
                                         ["1.0", "10.0 * l_discount", "10.0 * l_tax"], group="l_partkey"))
          + "SELECT model AS part, term, estimate, se, z, n AS n_used FROM (" + coef_rows("m", "g", ["(Intercept)", "discount", "tax"]) + ")")
def glm_by_part(spark, d):
    """M10 with many groups: one Poisson GLM quantity ~ discount + tax per
    part, the fits' state a table."""
    from abundance.models.glm_groups import glm_by_group
    li = V.table(spark, d, "lineitem").select("l_partkey", "l_quantity", (F.col("l_discount") * 10.0).alias("discount"), (F.col("l_tax") * 10.0).alias("tax"))
    fits = glm_by_group(li, "l_partkey", "l_quantity", ["discount", "tax"])
    return fin(fits.select(F.col("group").alias("part"), "term", "estimate", "se", "z", "n_used"), 4)


@register("importance_long", None)
def importance_long(spark, d):
    """C14: variable importance per response (from full-subset selection)
    widened to one column per predictor, then back to long with a label
    from a no-default case_when."""
    imp = _subsets(spark, d).importance
    wide = reshape.widen(imp, ["response"], "predictor", "importance", fill=0.0, levels=SUBSET_PREDICTORS)
    rule = ({"predictor": "sand", "resp_var": "total_abundance"}, "X")
    return fin(P.importance_long(wide, "response", rename_to="resp_var", label_rule=rule), 4)


@register("relief_classes", f"""
SELECT sample, level_5, CAST(sum(number) AS BIGINT) AS number,
  CAST(dense_rank() OVER (ORDER BY level_5) AS INTEGER) AS class_relief
FROM ({V.RELIEF_SQL}) GROUP BY sample, level_5""")
def relief_classes(spark, d):
    """V4: points per deployment x relief class (sum of multiplicities)
    with the class as an alphabetic factor level."""
    t = agg.sum_counts(V.relief(spark, d), ["sample", "level_5"], count="number")
    return clean.factor_levels(t, "level_5", "class_relief")


@register("lm_band", _with(*HABITAT_CTES, ("f", """SELECT regr_slope(turf, sand) AS b, regr_intercept(turf, sand) AS a,
    regr_count(turf, sand) AS n, regr_sxx(turf, sand) AS sxx, regr_syy(turf, sand) AS syy, regr_sxy(turf, sand) AS sxy,
    regr_avgx(turf, sand) AS xbar, min(sand) AS lo, max(sand) AS hi FROM habitat WHERE sand IS NOT NULL AND turf IS NOT NULL"""),
    ("z", "SELECT *, 1.959963984540054 AS z, n - 2.0 AS v FROM f"),
    # the t quantile by its expansion in 1 / degrees of freedom
    ("tq", """SELECT *, z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * v * v)
    + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3)) AS t FROM z"""),
    ("g", """SELECT *, lo + (hi - lo) * i / 79 AS x FROM tq, range(0, 80) r(i)"""),
    ("e", """SELECT *, a + b * x AS fit, sqrt((syy - sxy * sxy / sxx) / v * (1 / n + pow(x - xbar, 2) / sxx)) AS se FROM g""")) + """
SELECT ROUND(x, 6) AS sand, ROUND(fit, 6) AS fit, ROUND(se, 6) AS se, ROUND(fit - t * se, 6) AS lower, ROUND(fit + t * se, 6) AS upper FROM e""")
def lm_band(spark, d):
    """Fitted line turf ~ sand with its 95 % confidence band on 80
    points (geom_smooth(method = "lm") data)."""
    return fin(agg.lm_band(_habitat(spark, d), "sand", "turf", n_points=80))


@register("missing_maxn_rows", _with(*maxn_ctes(True)) + "SELECT * FROM maxn WHERE count IS NULL")
def missing_maxn_rows(spark, d):
    """The rows whose MaxN is missing (``which(is.na(count))`` as rows,
    since distributed rows have no positions)."""
    return agg.missing_rows(_maxn(spark, d, with_missing=True), "count")


_AB_SITE = ("abs", """SELECT a.response, r.site, a.number AS y
    FROM (SELECT sample, 'total_abundance' AS response, CAST(coalesce(sum(count), 0) AS DOUBLE) AS number FROM maxn GROUP BY 1
          UNION ALL
          SELECT sample, 'species_richness', CAST(sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) AS DOUBLE) FROM maxn GROUP BY 1) a
    JOIN roster_ok r ON r.sample = a.sample WHERE r.site IS NOT NULL""")


@register("glm_site_by_response", _with(ROSTER_OK, *maxn_ctes(), _AB_SITE,
    ("g", "SELECT response, site, avg(y) AS m, sum(y) AS s FROM abs GROUP BY 1, 2"),
    ("ref", "SELECT response, min(site) AS site FROM g GROUP BY 1"),
    ("r0", "SELECT g.* FROM g JOIN ref ON g.response = ref.response AND g.site = ref.site")) + """
SELECT r0.response AS model, '(Intercept)' AS term, ROUND(ln(r0.m), 4) AS estimate, ROUND(1 / sqrt(r0.s), 4) AS se FROM r0
UNION ALL
SELECT g.response, 'site' || g.site, ROUND(ln(g.m / r0.m), 4), ROUND(sqrt(1 / g.s + 1 / r0.s), 4)
FROM g JOIN r0 ON g.response = r0.response WHERE g.site <> r0.site""")
def glm_site_by_response(spark, d):
    """One Poisson GLM number ~ site per response (total abundance,
    species richness of the deployments with counts), all responses in the
    same passes; closed form per response."""
    from abundance.models.glm_groups import glm_by_group
    ab = P.abundance_long(_maxn(spark, d))
    fr = joins.natural_join(ab, _roster(spark, d).select("sample", "site"), "inner", on=["sample"])
    fits = glm_by_group(fr, "response", "number", ["site"])
    return fin(fits.select(F.col("group").alias("model"), "term", "estimate", "se"), 4)


@register("glm_site_aic", _with(ROSTER_OK, *maxn_ctes(), ("ab", """SELECT r.sample, r.site,
    CAST(coalesce(t.n, 0) AS DOUBLE) AS y FROM roster_ok r
    LEFT JOIN (SELECT sample, sum(count) AS n FROM maxn GROUP BY 1) t ON t.sample = r.sample
    WHERE r.site IS NOT NULL"""), ("g", "SELECT site, avg(y) AS m FROM ab GROUP BY site")) + """
SELECT 'glm0' AS model, CAST((SELECT count(*) FROM g) AS INTEGER) AS df, count(*) AS n_used,
  ROUND(sum(ab.y * ln(g.m) - g.m - lgamma(ab.y + 1)), 4) AS loglik,
  ROUND(-2 * sum(ab.y * ln(g.m) - g.m - lgamma(ab.y + 1)) + 2 * (SELECT count(*) FROM g), 4) AS aic
FROM ab JOIN g ON ab.site = g.site""")
def glm_site_aic(spark, d):
    """M5: AIC table row of glm0 (number ~ site): parameters, rows used,
    log-likelihood and AIC (closed form at the group means)."""
    from abundance.models.glm import aic_table, glm
    f = glm(_frame(spark, d), "number", ["site"])
    return fin(aic_table(spark, {"glm0": f}).select("model", "df", "n_used", "loglik", "aic"), 4)


@register("describe_events_exact", _describe_sql("events", ["value"]))
def describe_events_exact(spark, d):
    """A15 at raw-table scale: exact type-7 quartiles of the event values."""
    return fin(agg.describe_num(V.table(spark, d, "events"), ["value"]))


@register("describe_lineitem_tied", _describe_sql("lineitem", ["l_quantity", "l_discount", "l_tax"]))
def describe_lineitem_tied(spark, d):
    """A15 on heavily tied columns (at most 50 different values)."""
    li = V.table(spark, d, "lineitem").select(*[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return fin(agg.describe_num(li, ["l_quantity", "l_discount", "l_tax"]))


@register("weighted_moments_large", """
SELECT o_orderpriority, ROUND(avg(x), 4) AS mean, ROUND(stddev_samp(x), 4) AS sd
FROM (SELECT o_orderpriority, o_totalprice + 1e9 AS x FROM orders, range(1 + o_custkey % 3) t(i)) GROUP BY 1""")
def weighted_moments_large(spark, d):
    """A6 on large values: weighted mean and sd keep their digits."""
    o = V.table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") + 1e9).alias("x"),
                                           (1 + F.col("o_custkey") % 3).alias("w"))
    return fin(agg.weighted_moments(o, ["o_orderpriority"], "x", "w"), 4)


@register("anti_join_roster", _with(ROSTER_OK, *maxn_ctes()) + """
SELECT sample, campaignid, site, ROUND(depth_m, 6) AS depth_m FROM roster_ok r
WHERE NOT EXISTS (SELECT 1 FROM maxn m WHERE m.sample = r.sample)""")
def anti_join_roster(spark, d):
    """Roster rows without counts, with all their columns."""
    r = _roster(spark, d).select("sample", "campaignid", "site", "depth_m")
    return fin(joins.anti_join(r, _maxn(spark, d).select("sample"), on=["sample"]))


@register("anti_join_counts", _with(ROSTER_OK, *maxn_ctes()) + """
SELECT * FROM maxn m WHERE NOT EXISTS (SELECT 1 FROM roster_ok r WHERE m.sample = r.sample)""")
def anti_join_counts(spark, d):
    """MaxN rows without a successful deployment, with all their columns."""
    return joins.anti_join(_maxn(spark, d), _roster(spark, d).select("sample"), on=["sample"])


@register("species_habitat", _with(*HABITAT_CTES, *maxn_ctes(), ("s", f"""
    SELECT sample, genus || ' ' || species AS label2, CAST(sum(count) AS BIGINT) AS count
    FROM maxn WHERE genus || ' ' || species = '{V.FOCAL_LABEL}' GROUP BY 1, 2""")) + """
SELECT h.sample, s.label2, coalesce(s.count, 0) AS count, h.site, ROUND(h.depth_m, 6) AS depth_m, ROUND(h.sand, 6) AS sand,
  ROUND(h.turf, 6) AS turf, ROUND(h.mean_relief, 6) AS mean_relief
FROM s RIGHT JOIN habitat h ON s.sample = h.sample""")
def species_habitat(spark, d):
    """One taxon with true zeros, joined to the habitat covariates."""
    m = _maxn(spark, d).withColumn("label2", taxon_label("genus", "species"))
    h = _habitat(spark, d)
    out = P.species_with_zeros(m, h.select("sample", "site", "depth_m"), h.select("sample", "sand", "turf", "mean_relief"),
                               V.FOCAL_LABEL, taxon="label2", sum_keys=["sample", "label2"])
    return fin(out.select("sample", "label2", "count", "site", "depth_m", "sand", "turf", "mean_relief"))


@register("cover_proportions", _with(CLASSIFIED, COMPOSITION) + "SELECT sample, " + ", ".join(
    f"ROUND({c} / nullif(CAST(total_points_annotated AS DOUBLE), 0), 6) AS {c}" for c in V.HABITAT_CLASSES) + " FROM composition")
def cover_proportions(spark, d):
    """Habitat counts as proportions of the points annotated."""
    comp = agg.class_composition(clean.classify(V.benthos(spark, d), V.HABITAT_RULES, "habitat"), ["sample"], "habitat",
                                 "number", V.HABITAT_CLASSES, long=False)
    total = F.col("total_points_annotated").cast("double")
    return fin(comp.select("sample", *[F.try_divide(F.col(c).cast("double"), total).alias(c) for c in V.HABITAT_CLASSES]))


# ------------------------------------------- round trips of sources and sinks

def _folder(spark, name):
    import uuid

    from abundance.session import checkpoint_dir
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"


@register("csv_round_trip", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def csv_round_trip(spark, d):
    """S1 + S4: the customers written as CSV and read back with types and a
    missing-value sentinel."""
    from abundance.sources.io import read_survey_csv, write_csv
    t = V.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = write_csv(t, _folder(spark, "csv"))
    types = {c: k for c, k in t.dtypes if k != "string"}
    return read_survey_csv(spark, path, types=types, sentinels=("NA", "BUILDING"))


@register("tsv_round_trip", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, o_orderstatus FROM orders")
def tsv_round_trip(spark, d):
    """The orders written as tab-delimited files under a preamble of four
    lines and read back, as text."""
    from abundance.sources.io import read_tsv_with_preamble, write_tsv_with_preamble
    t = V.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    path = write_tsv_with_preamble(t, _folder(spark, "tsv"), ["annotation export", "", "made by a tool", "rows follow"])
    return read_tsv_with_preamble(spark, path, skip=4)


@register("campaign_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def campaign_round_trip(spark, d):
    """S3 + S5: the suppliers saved as one campaign's partition beside another
    campaign, saved again, and loaded by campaign."""
    from abundance.sources.io import Campaign, load_table, save_table
    t = V.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    root = _folder(spark, "campaigns")
    for name, rows in (("a", t.where("s_nationkey < 10")), ("b", t), ("a", t)):
        save_table(rows, Campaign(name, root), "suppliers")
    return load_table(spark, Campaign("a", root), "suppliers")


@register("map_extent_saved", """SELECT sample, ROUND(lon, 6) AS lon, ROUND(lat, 6) AS lat FROM (
  SELECT o_orderkey AS sample, (o_orderkey * 7919) % 36000 / 100.0 - 180 AS lon, (o_custkey * 104729) % 18000 / 100.0 - 90 AS lat FROM orders)
  WHERE lon BETWEEN 100 AND 136 AND lat BETWEEN -40 AND -22""")
def map_extent_saved(spark, d):
    """P19 + S3: points saved along a space-filling curve, then the rows of a
    map extent of one per cent of the globe (row groups outside are skipped)."""
    from abundance.sources.io import save_points
    o = V.table(spark, d, "orders")
    pts = o.select(F.col("o_orderkey").alias("sample"), (F.pmod(F.col("o_orderkey") * 7919, F.lit(36000)) / 100.0 - 180).alias("lon"),
                   (F.pmod(F.col("o_custkey") * 104729, F.lit(18000)) / 100.0 - 90).alias("lat"))
    path = save_points(pts, _folder(spark, "points"), "lon", "lat")
    return fin(clean.within_bbox(spark.read.parquet(path), "lon", "lat", (100, 136), (-22, -40)))


@register("scatter_sample", """SELECT o_orderkey, o_custkey, ROUND(o_totalprice, 6) AS o_totalprice FROM orders
  WHERE o_totalprice IS NOT NULL ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 2000""")
def scatter_sample_q(spark, d):
    """V5: a scatter plot's sample of 2,000 points at most, the same rows on
    every run (the limit is the feature)."""
    from abundance.operators.charts import scatter_sample as sample
    return fin(sample(V.table(spark, d, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"], 2000))


@register("running_total", """SELECT o_orderpriority, o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderpriority
  ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM orders""")
def running_total_q(spark, d):
    """W3 over few and large groups: a two-level prefix sum."""
    o = V.table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_custkey")
    return rank.running_total(o, ["o_orderpriority"], ["o_orderkey"], "o_custkey", "running", bounded=False).select("o_orderpriority", "o_orderkey", "running")


# ------------------------------------------- selection with an oracle, penalised smooth

RANKED = {"null": [], "sand": ["sand"], "turf": ["turf"], "depth_m": ["depth_m"], "sand+turf": ["sand", "turf"],
          "sand+depth_m": ["sand", "depth_m"], "turf+depth_m": ["turf", "depth_m"]}
_AB = ("ab", """SELECT sample, 'total_abundance' AS response, CAST(coalesce(sum(count), 0) AS DOUBLE) AS number FROM maxn GROUP BY 1
    UNION ALL SELECT sample, 'species_richness', CAST(sum(CASE WHEN count > 0 THEN 1 ELSE 0 END) AS DOUBLE) FROM maxn GROUP BY 1""")
_RANK_SRC = """SELECT a.response, a.number, h.depth_m / 100000.0 AS depth_m, h.sand / 100.0 AS sand, h.turf / 100.0 AS turf
    FROM ab a JOIN habitat h ON a.sample = h.sample WHERE h.depth_m IS NOT NULL AND h.sand IS NOT NULL AND h.turf IS NOT NULL"""


def _ranked_ctes():
    parts, rows = [], []
    for i, (name, xs) in enumerate(RANKED.items()):
        parts += glm_ctes(f"k{i}", _RANK_SRC, "number", ["1.0", *xs], group="response")
        k = 1 + len(xs)
        rows.append(f"SELECT g AS response, '{name}' AS modname, n AS n_used, {k} AS edf, -2 * ll + 2 * {k} + 2.0 * {k} * {k + 1} / (n - {k} - 1) AS aicc FROM k{i}_fit")
    weights = """SELECT *, aicc - min(aicc) OVER (PARTITION BY response) AS delta_aicc FROM ranked0"""
    return [*HABITAT_CTES, *maxn_ctes(), _AB, *parts, ("ranked0", " UNION ALL ".join(rows)), ("ranked1", weights),
            ("ranked", "SELECT *, exp(-delta_aicc / 2) / sum(exp(-delta_aicc / 2)) OVER (PARTITION BY response) AS wi_aicc FROM ranked1")]


def _ranked(spark, d):
    from abundance.models.select import full_subsets
    ab = P.abundance_long(_maxn(spark, d))
    fr = joins.natural_join(ab, _habitat(spark, d).select("sample", "depth_m", "sand", "turf"), "inner", on=["sample"])
    fr = fr.withColumns({"depth_m": F.col("depth_m") / 100000.0, "sand": F.col("sand") / 100.0, "turf": F.col("turf") / 100.0})
    return full_subsets(fr, "number", ["sand", "turf", "depth_m"], response="response", max_size=2, cor_cutoff=1.1, smooth=False)


@register("subset_ranking", _with(*_ranked_ctes()) + """
SELECT response, modname, n_used, CAST(edf AS INTEGER) AS edf, ROUND(aicc, 2) AS aicc, ROUND(delta_aicc, 2) AS delta_aicc, ROUND(wi_aicc, 4) AS wi_aicc,
  ROUND(sum(wi_aicc) OVER (PARTITION BY response ORDER BY aicc, modname ROWS UNBOUNDED PRECEDING), 4) AS cumsum_wi FROM ranked""")
def subset_ranking(spark, d):
    """M7 + C15: full-subset search over three linear predictors, up to two at
    a time, per response: AICc, delta, Akaike weights, cumulative weights."""
    m = _ranked(spark, d).models
    return m.select("response", "modname", "n_used", "edf", F.round("aicc", 2).alias("aicc"), F.round("delta_aicc", 2).alias("delta_aicc"),
                    F.round("wi_aicc", 4).alias("wi_aicc"), F.round("cumsum_wi", 4).alias("cumsum_wi"))


@register("subset_importance", _with(*_ranked_ctes(), ("p", "SELECT unnest(['sand', 'turf', 'depth_m']) AS predictor")) + """
SELECT response AS resp_var, predictor, ROUND(coalesce(sum(wi_aicc) FILTER (WHERE list_contains(string_split(modname, '+'), predictor)), 0), 4) AS importance,
  CASE WHEN predictor = 'sand' AND response = 'total_abundance' THEN 'X' END AS label
FROM ranked, p GROUP BY response, predictor""")
def subset_importance(spark, d):
    """C14: variable importance of that search, widened to one column per
    predictor and back to long with a label from a no-default case_when."""
    imp = _ranked(spark, d).importance
    wide = reshape.widen(imp, ["response"], "predictor", "importance", fill=0.0, levels=["sand", "turf", "depth_m"])
    rule = ({"predictor": "sand", "resp_var": "total_abundance"}, "X")
    return fin(P.importance_long(wide, "response", rename_to="resp_var", label_rule=rule), 4)


PENALTY = 50.0
SMOOTH_KNOTS = [0.0, 1.5, 3.0, 5.5]


def _penalised_sql() -> str:
    from abundance.models.spline import spline_penalty
    t = SMOOTH_KNOTS

    def cube(k):
        return f"power(greatest(depth_m / 100000.0 - {k}, 0), 3)"

    def ramp(j):
        return f"(({cube(t[j])} - {cube(t[-1])}) / {t[-1] - t[j]})"

    xs = ["1.0", "depth_m / 100000.0", *[f"{ramp(j)} - {ramp(len(t) - 2)}" for j in range(len(t) - 2)]]
    S = spline_penalty(t)
    add = {(i + 1, j + 1): PENALTY * S[i, j] for i in range(len(S)) for j in range(len(S))}
    ctes = glm_ctes("m", "SELECT number, depth_m FROM frame", "number", xs, steps=12, penalty=add)
    src = ("frame", "SELECT r.sample, r.depth_m, CAST(coalesce(s.n, 0) AS DOUBLE) AS number FROM roster_ok r "
                    "LEFT JOIN (SELECT sample, sum(count) AS n FROM maxn GROUP BY 1) s ON r.sample = s.sample")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS term, ROUND(b{i}, 4) + 0.0 AS estimate, ROUND(s{i}, 4) AS se FROM m_fit"
                              for i, n in enumerate(["(Intercept)", "s(depth_m).1", "s(depth_m).2", "s(depth_m).3"]))
    return _with(ROSTER_OK, *maxn_ctes(), src, *ctes) + rows


@register("penalised_smooth", _penalised_sql())
def penalised_smooth(spark, d):
    """M6: total abundance on a penalised cubic regression spline of depth, at
    a given smoothing parameter."""
    from abundance.models.spline import penalised_spline_glm
    fr = _frame(spark, d).select("number", (F.col("depth_m") / 100000.0).alias("depth_m"))
    f = penalised_spline_glm(fr, "number", ["depth_m"], k=4, lam=PENALTY, knots={"depth_m": SMOOTH_KNOTS})
    rows = [(t, round(b, 4) + 0.0, round(s, 4)) for t, b, s, _z, _p in f.table()]
    return spark.createDataFrame(rows, "term string, estimate double, se double")
