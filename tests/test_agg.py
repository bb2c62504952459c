import math

from pyspark.sql import functions as F

from abundance.operators import agg, rank
from abundance.plans import pipelines as P


def test_max_n_na_rule(spark):
    df = spark.createDataFrame([("S1", "t", 3), ("S1", "t", 5), ("S2", "t", None), ("S2", "t", 2)],
                               "sample string, taxon string, count long")
    strict = {r.sample: r["count"] for r in agg.max_n(df, ["sample", "taxon"]).collect()}
    assert strict == {"S1": 5, "S2": None}
    loose = {r.sample: r["count"] for r in agg.max_n(df, ["sample", "taxon"], na_rm=True).collect()}
    assert loose == {"S1": 5, "S2": 2}


def _relief(spark):
    return spark.createDataFrame(
        [("A", "0", 0), ("A", "2", 1), ("A", "3", 4), ("B", "4", 1), ("C", "x", 2), ("C", "1", 1)],
        "sample string, level_5 string, number long")


def test_weighted_moments_equal_uncount(spark):
    r = _relief(spark)
    got = {x.sample: (x.mean_relief, x.sd_relief) for x in P.relief_summary(r).collect()}
    a_vals = [2] + [3] * 4
    m = sum(a_vals) / 5
    sd = math.sqrt(sum((v - m) ** 2 for v in a_vals) / 4)
    assert math.isclose(got["A"][0], m) and math.isclose(got["A"][1], sd)
    assert got["B"] == (4.0, None)                 # total weight 1 -> sd NULL
    assert got["C"][0] is None                     # bad text -> NULL mean (R rule)
    u = agg.uncount(r, "number").withColumn("x", F.col("level_5").try_cast("double"))
    ref = {x.sample: x.sd for x in u.groupBy("sample").agg(F.stddev_samp("x").alias("sd")).collect()}
    assert all((ref[k] is None and v[1] is None) or math.isclose(ref[k], v[1]) for k, v in got.items())


def test_size_at_maturity(spark):
    df = spark.createDataFrame(
        [("F", "G", "s", "F", 300.0), ("F", "G", "s", "F", 300.0), ("F", "G", "s", "M", 400.0),
         ("F", "G", "s", "M", 500.0), ("F", "G", "t", "M", None)],
        "family string, genus string, species string, sex string, l50_mm double")
    got = [(r.species, r.lm) for r in agg.size_at_maturity(df, ["family", "genus", "species"]).collect()]
    assert got == [("s", 350.0)]


def test_first_by_min_ties(spark):
    df = spark.createDataFrame([("a", 1.0, 2, "x"), ("a", 1.0, 1, "y"), ("a", None, 0, "z")],
                               "g string, v double, rid int, other string")
    r = rank.first_by_min(df, ["g"], "v", ["rid"]).first()
    assert (r.v, r.rid, r.other) == (1.0, 1, "y")


def test_abundance_richness_skip_first(spark):
    rows = [("S1", f"sp{i}", i + 1) for i in range(5)] + [("S2", "sp4", 2)]
    df = spark.createDataFrame(rows, "sample string, scientific string, count long")
    full = {(r.sample, r.response): r.number for r in agg.abundance_richness(df, ["sample"]).collect()}
    assert full[("S1", "total_abundance")] == 15 and full[("S1", "species_richness")] == 5
    skip = {(r.sample, r.response): r.number
            for r in agg.abundance_richness(df, ["sample"], skip_first=3, order_cols=["sample", "scientific"]).collect()}
    assert skip[("S1", "total_abundance")] == 9 and skip[("S1", "species_richness")] == 2
    assert skip[("S2", "total_abundance")] == 2


def test_describe_num_type7(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,), (None,)], "x double")
    r = agg.describe_num(df, ["x"]).first()
    assert (r.q1, r.median, r.q3, r.n_missing, r.min, r.max) == (1.75, 2.5, 4.75, 1, 1.0, 10.0)


def test_zero_fraction_strict(spark):
    rows = [("a", 0)] * 95 + [("a", 1)] * 5 + [("b", 0)] * 94 + [("b", 1)] * 6
    df = spark.createDataFrame(rows, "response string, number long")
    assert [r.response for r in agg.zero_fraction(df, "response", "number").collect()] == ["b"]


def test_class_composition_unclassified(spark):
    df = spark.createDataFrame([("S1", "sand", 2), ("S1", "turf", 1), ("S1", None, 3), ("S1", "posidonia", None)],
                               "sample string, habitat string, number long")
    r = agg.class_composition(df, ["sample"], "habitat", "number", ["posidonia", "sand", "turf"], long=False).first()
    assert (r.total_points_annotated, r.unclassified, r.sand, r.turf, r.posidonia) == (6, 3, 2, 1, 0)


def test_size_classes_strict(spark):
    ln = spark.createDataFrame([("S1", 279.0, 1, 300.0), ("S1", 280.0, 1, 300.0), ("S1", 281.0, 1, 300.0),
                                ("S1", 300.0, 1, 300.0), ("S1", 400.0, 1, None)],
                               "sample string, length_mm double, number long, lm double")
    roster = spark.createDataFrame([("S1",), ("S2",)], "sample string")
    got = {(r.sample, r.response): r.number for r in agg.size_class_abundance(ln, roster, ["sample"]).collect()}
    assert got[("S1", "Mature")] == 0 and got[("S1", "Immature")] == 3
    assert got[("S1", "Legal")] == 3 and got[("S1", "Sublegal")] == 1 and got[("S2", "Legal")] == 0


def test_corr_matrix_and_na(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.1, None), (3.0, 6.3, 2.0)], "a double, b double, c double")
    got = {(r.var1, r.var2): r.r for r in agg.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] is None and got[("a", "b")] > 0.99


def test_mean_se(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 3.0), ("s", None)], "g string, x double")
    r = agg.mean_se(df, ["g"], "x").first()
    assert r.mean == 2.0 and math.isclose(r.se, math.sqrt(2) / math.sqrt(2))


def test_lm_band_matches_closed_form(spark):
    import numpy as np
    xs = np.arange(10.0)
    ys = 2.0 + 0.5 * xs + np.array([0.1, -0.2, 0.05, 0.3, -0.1, 0.0, 0.2, -0.3, 0.1, -0.05])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys)], "x double, y double")
    band = {round(r.x, 6): r for r in agg.lm_band(df, "x", "y", n_points=10).collect()}
    b, a = np.polyfit(xs, ys, 1)
    resid = ys - (a + b * xs)
    s = math.sqrt((resid ** 2).sum() / 8)
    se0 = s * math.sqrt(1 / 10 + (0 - xs.mean()) ** 2 / ((xs - xs.mean()) ** 2).sum())
    r0 = band[0.0]
    assert math.isclose(r0.fit, a, rel_tol=1e-9) and math.isclose(r0.se, se0, rel_tol=1e-9)
    assert math.isclose(r0.upper - r0.fit, 2.306004135 * se0, rel_tol=1e-6)      # t(0.975, 8)


def test_qa_report_counts(spark):
    roster = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "sample string")
    table = spark.createDataFrame([("S1", 1), ("S1", 2), ("S4", 3)], "sample string, n int")
    got = {r.check: r.value for r in P.qa_report(roster, table, ["sample"]).collect()}
    assert got == {"roster_rows": 3, "table_rows": 3, "roster_only": 2, "table_only": 1}


def test_importance_long_label(spark):
    wide = spark.createDataFrame([("A", 0.2, 0.9), ("B", 1.0, 0.1)], "X string, sand double, turf double")
    out = P.importance_long(wide, "X", label_rule=({"predictor": "turf", "resp_var": "A"}, "X"))
    got = sorted((r.resp_var, r.predictor, r.importance, r.label) for r in out.collect())
    assert got == [("A", "sand", 0.2, None), ("A", "turf", 0.9, "X"), ("B", "sand", 1.0, None), ("B", "turf", 0.1, None)]


def test_habitat_table_null_vs_literal_zero(spark):
    roster = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "sample string")
    benthos = spark.createDataFrame([("S1", "A", "F", "x", 3), ("S1", "N", "F", "x", 1), ("S2", "R", "O", "y", 2)],
                                    "sample string, level_2 string, level_3 string, scientific string, number long")
    relief = spark.createDataFrame([("S1", "2", 1), ("S1", "3", 1)], "sample string, level_5 string, number long")
    rules = [({"level_2": "A", "level_3": "F"}, "sand"), ({"level_2": "N"}, "turf")]
    got = {r.sample: r for r in P.habitat_table(roster, benthos, relief, rules, ["sand", "turf"]).collect()}
    assert got["S1"].sand == 75.0 and got["S1"].turf == 25.0 and got["S1"].mean_relief == 2.5
    assert got["S2"].sand == 0.0 and got["S2"].total_points_annotated == 2      # unclassified still counted
    assert got["S3"].sand is None and got["S3"].turf is None                   # no benthos: NULL (T9)
    lit = {r.sample: r for r in P.habitat_table(roster, benthos, relief, rules, ["sand", "turf"], literal=True).collect()}
    assert lit["S3"].sand == 0.0 and lit["S3"].turf == 0.0


def test_size_classes_join_free_equals_join(spark):
    from pyspark.sql import functions as F
    ln = spark.createDataFrame([("S1", "a", 300.0, 2, 250.0), ("S1", "b", 100.0, 1, 250.0),
                                ("S2", "b", 500.0, 3, 250.0), ("S3", "a", 260.0, 1, 250.0)],
                               "sample string, taxon string, length_mm double, number long, lm double")
    focal = F.col("taxon") == "a"
    free = agg.size_class_abundance(ln, None, ["sample"], focal=focal)
    roster = ln.select("sample").distinct()
    joined = agg.size_class_abundance(ln, roster, ["sample"], focal=focal)
    assert sorted(tuple(r) for r in free.collect()) == sorted(tuple(r) for r in joined.collect())
    assert {(r.sample, r.response): r.number for r in free.collect()}[("S2", "Mature")] == 0


def test_habitat_grouped_equals_joined(spark):
    roster = spark.createDataFrame([("S1", "A"), ("S2", "B"), ("S3", "C"), ("S3", "C2"), (None, "N")],
                                   "sample string, site string")
    benthos = spark.createDataFrame([("S1", "A", "F", "x", 3), ("S1", "N", "F", "x", 1), ("S2", "R", "O", "y", 2),
                                     (None, "A", "F", "x", 5), ("S9", "N", "F", "x", 1), ("S2", "N", "O", "y", None)],
                                    "sample string, level_2 string, level_3 string, scientific string, number long")
    relief = spark.createDataFrame([("S1", "2", 1), ("S1", "3", 2), ("S2", "x", 1), ("S3", "4", 0), (None, "1", 3)],
                                   "sample string, level_5 string, number long")
    rules = [({"level_2": "A", "level_3": "F"}, "sand"), ({"level_2": "N"}, "turf")]
    for literal in (False, True):
        g = P.habitat_table(roster, benthos, relief, rules, ["sand", "turf"], literal=literal)
        j = P.habitat_table_joined(roster, benthos, relief, rules, ["sand", "turf"], literal=literal)
        cols = sorted(j.columns)
        assert sorted(g.columns) == cols
        norm = lambda df: sorted(tuple(str(round(v, 12) if isinstance(v, float) else v) for v in (r[c] for c in cols)) for r in df.collect())
        assert norm(g) == norm(j)


def test_exact_quantiles_distributed(spark):
    import numpy as np
    rng = np.random.default_rng(8)
    vals = np.concatenate([rng.normal(size=20000), rng.integers(0, 5, 5000).astype(float)])   # ties too
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "x double").repartition(7)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = agg.exact_quantiles(df, "x", probs)
    ref = np.quantile(vals, probs)            # numpy default = R type 7
    assert np.allclose(got, ref, rtol=0, atol=1e-12)
    small = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert agg.exact_quantiles(small, "x", [0.25, 0.5, 0.75]) == [1.75, 2.5, 4.75]


def test_describe_equals_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=3000), rng.gamma(2, size=3000)
    df = spark.createDataFrame([(float(v), float(w), None) for v, w in zip(a, b)], "a double, b double, c double")
    got = {r.column: r for r in agg.describe_num(df, ["a", "b", "c"]).collect()}
    for c, v in (("a", a), ("b", b)):
        q = np.quantile(v, [0, 0.25, 0.5, 0.75, 1])
        assert np.allclose([got[c][f] for f in ("min", "q1", "median", "q3", "max")], q, rtol=0, atol=1e-12)
    assert got["c"]["q1"] is None and got["c"]["n_missing"] == 3000


def test_richness_na_rule(spark):
    df = spark.createDataFrame([("S1", "a", 2), ("S1", "b", None), ("S2", "a", 3), ("S2", "b", 0)],
                               "sample string, scientific string, count long")
    r = {(x.sample, x.response): x.number for x in agg.abundance_richness(df, ["sample"]).collect()}
    assert r[("S1", "total_abundance")] == 2 and r[("S1", "species_richness")] is None     # R: rowSums(. > 0)
    assert r[("S2", "species_richness")] == 1
    r2 = {(x.sample, x.response): x.number
          for x in agg.abundance_richness(df, ["sample"], na_rm_richness=True).collect()}
    assert r2[("S1", "species_richness")] == 1


def test_select_ranks_equal_sorting(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(3)
    n = 20_000
    pdf = pd.DataFrame({"wide": np.exp(rng.normal(size=n) * 8), "ties": rng.integers(0, 3, n).astype(float), "halves": np.where(np.arange(n) < n // 2, 0.0, 1.0),
                        "ends": np.where(np.arange(n) < 9000, -5.0, np.where(np.arange(n) < 18000, 5.0, rng.random(n))), "one": np.full(n, 7.0),
                        "gaps": np.where(rng.random(n) < 0.3, np.nan, -rng.random(n) * 1e-300)})
    df = spark.createDataFrame(pdf).repartition(6)
    ranks = lambda n: [0, 1, n // 4, n // 2 - 1, n // 2, n - 1]
    for accuracy, window in ((10_000, 50_000), (100, 50), (20, 10)):      # the small ones need several rounds
        got = agg.select_ranks(df, list(pdf), ranks, accuracy, window)
        for c in pdf:
            v = np.sort(pdf[c].dropna().to_numpy())
            assert got[c] == (len(v), {k: v[k] for k in ranks(len(v))}), (c, window)
    assert agg.select_ranks(df.limit(0), ["one"], ranks) == {"one": (0, {})}


def test_weighted_moments_far_from_zero_in_one_scan(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", None], 3000), "x": 1e9 + rng.normal(size=3000), "w": rng.integers(0, 4, 3000)})
    pdf.loc[pdf.k == "b", "x"] = -3e7 + 1e-3 * rng.normal(size=(pdf.k == "b").sum())
    out = agg.weighted_moments(spark.createDataFrame(pdf).repartition(5), ["k"], "x", "w")
    for r in out.collect():
        v = pdf[pdf.k.isna() if r.k is None else pdf.k == r.k]
        x = np.repeat(v.x.to_numpy(), v.w)
        assert abs(r.mean - x.mean()) < 1e-9 * abs(x.mean()) and abs(r.sd / x.std(ddof=1) - 1) < (2e-5 if r.k == "b" else 1e-6)
    fresh = agg.weighted_moments(spark.range(9).selectExpr("id % 2 k", "id x", "1 w"), ["k"], "x", "w")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "MergeJoin" not in plan and "HashJoin" not in plan and plan.count("Exchange hashpartitioning") == 2 and plan.count("Range (") == 1
