from pyspark.sql import functions as F

from abundance.functions.columns import in_set, taxon_label
from abundance.operators import clean


def test_clean_names_dirty(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Video location` int, `mean.relief` int, `Mean Relief` int")
    assert clean.clean_names(df).columns == ["video_location", "mean_relief", "mean_relief_2"]


def test_exclude_values_r_semantics(spark):
    df = spark.createDataFrame([("Unknown",), ("",), (None,), ("Sand",)], "broad string")
    out = clean.exclude_values(df, "broad", ["Unknown", None, ""]).collect()
    assert [r.broad for r in out] == ["Sand"]


def test_in_set_never_null(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    got = df.select(in_set("x", ["a"]).alias("k"), in_set("x", ["b", None]).alias("n")).collect()
    assert [(r.k, r.n) for r in got] == [(True, False), (False, True)]


def test_taxon_label_writes_na(spark):
    df = spark.createDataFrame([("Labridae", None, "sp1")], "family string, genus string, species string")
    assert df.select(taxon_label("family", "genus", "species").alias("s")).first().s == "Labridae NA sp1"


def test_local_date_early_morning(spark):
    df = spark.createDataFrame([("2025-04-23T07:38:00+08:00",)], "date_time string")
    r = clean.split_local_datetime(df, "date_time").first()
    assert (r.date, r.time) == ("2025-04-23", "07:38:00")


def test_relabel_rules_in_order(spark):
    df = spark.createDataFrame(
        [("Monacanthidae", "Unknown", "novaezelandiae"), ("Labridae", "Unknown", "x"), (None, None, None)],
        "family string, genus string, species string")
    rules = [("species", "spp", {"species": "novaezelandiae"}),
             ("genus", "Acanthaluteres", {"genus": "Unknown", "family": "Monacanthidae"})]
    got = [tuple(r) for r in clean.relabel(df, rules).collect()]
    assert got == [("Monacanthidae", "Acanthaluteres", "spp"), ("Labridae", "Unknown", "x"), (None, None, None)]


def test_classify_no_default(spark):
    df = spark.createDataFrame([("Substrate", "Unconsolidated (soft)"), ("Other", "x")], "level_2 string, level_3 string")
    rules = [({"level_2": "Substrate", "level_3": "Unconsolidated (soft)"}, "sand"), ({"level_2": "Macroalgae"}, "turf")]
    assert [r.habitat for r in clean.classify(df, rules, "habitat").collect()] == ["sand", None]


def test_strict_thresholds(spark):
    df = spark.createDataFrame([(279.0, 300.0), (280.0, 300.0), (281.0, 281.0), (301.0, None)], "length_mm double, lm double")
    assert [r.length_mm for r in clean.strictly_above(df, "length_mm", 280.0).collect()] == [281.0, 301.0]
    assert [r.length_mm for r in clean.strictly_below(df, "length_mm", "lm").collect()] == [279.0, 280.0]


def test_to_numeric_bad_text(spark):
    df = spark.createDataFrame([("3",), ("x",), (None,)], "level_5 string")
    assert [r.level_5 for r in clean.to_numeric(df, ["level_5"]).collect()] == [3.0, None, None]


def test_within_bbox_high_to_low(spark):
    df = spark.createDataFrame([(117.9, -35.05), (117.0, -35.05)], "lon double, lat double")
    out = clean.within_bbox(df, "lon", "lat", (117.839435, 117.949606), (-35.007973, -35.091606))
    assert out.count() == 1


def test_factor_levels_alphabetic(spark):
    df = spark.createDataFrame([("C",), ("A",), ("B",), ("A",)], "site string")
    got = sorted((r.site, r.site_level) for r in clean.factor_levels(df, "site").collect())
    assert got == [("A", 1), ("A", 1), ("B", 2), ("C", 3)]


def test_factor_levels_of_any_number(spark):
    df = spark.range(300_000).selectExpr("case when id % 2 = 0 then 'hot' when id % 50 = 1 then null else lpad(id, 7, '0') end v", "id", "'x' n")
    out = clean.factor_levels(df, "v")
    r = out.selectExpr("count(*) n", "max(v_level) top", "count(v_level) known", "count(distinct v_level) levels").first()
    assert (r.n, r.known, r.top, r.levels) == (300_000, 294_000, 144_001, 144_001)
    assert out.where("v = 'hot'").select("v_level").distinct().collect()[0][0] == 144_001
    assert out.where("id = 3").first().v_level == 1
