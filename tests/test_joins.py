from abundance.operators import joins


def test_null_keys_match_and_no_anti_row(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    got = sorted((r.k or "", r.a, r.b) for r in joins.natural_join(a, b, "left").collect())
    assert got == [("", 1, 10), ("x", 2, 20)]
    assert joins.anti_join(a, b).count() == 0


def test_zero_fill_roster(spark):
    roster = spark.createDataFrame([("S1",), ("S2",), ("S3",), ("S4",)], "sample string")
    obs = spark.createDataFrame([("S1", 3), ("S2", 5)], "sample string, count long")
    got = sorted((r.sample, r["count"]) for r in joins.zero_fill(obs, roster, ["sample"], ["count"]).collect())
    assert got == [("S1", 3), ("S2", 5), ("S3", 0), ("S4", 0)]


def test_zero_fill_grid(spark):
    roster = spark.createDataFrame([("S1",), ("S2",)], "sample string")
    obs = spark.createDataFrame([("S1", "a", 3), ("S2", "b", 1)], "sample string, taxon string, count long")
    got = sorted(tuple(r) for r in joins.zero_fill_grid(obs, roster, ["sample"], ["taxon"], ["count"]).collect())
    assert got == [("S1", "a", 3), ("S1", "b", 0), ("S2", "a", 0), ("S2", "b", 1)]


def test_mismatch_report_both_sides(spark):
    a = spark.createDataFrame([("S1",), ("S2",)], "sample string")
    b = spark.createDataFrame([("S2",), ("S3",)], "sample string")
    got = sorted(tuple(r) for r in joins.mismatch_report(a, b).collect())
    assert got == [("S1", "left_only"), ("S3", "right_only")]


def test_right_join_keeps_right_key(spark):
    a = spark.createDataFrame([("S1", 1)], "sample string, n int")
    b = spark.createDataFrame([("S1",), ("S9",)], "sample string")
    got = sorted((r.sample, r.n) for r in joins.natural_join(a, b, "right").collect())
    assert got == [("S1", 1), ("S9", None)]


def test_zero_fill_grid_indexed_path(spark):
    roster = spark.createDataFrame([("S1",), ("S2",)], "sample string")
    obs = spark.createDataFrame([("S1", "a", 3), ("S2", "b", 1)], "sample string, taxon string, count long")
    got = sorted(tuple(r) for r in joins.zero_fill_grid(obs, roster, ["sample"], ["taxon"], ["count"]).collect())
    assert got == [("S1", "a", 3), ("S1", "b", 0), ("S2", "a", 0), ("S2", "b", 1)]


def test_na_matches_never(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, b int")
    got = sorted((r.k or "", r.a, r.b) for r in joins.natural_join(a, b, "left", na_matches="never").collect())
    assert got == [("", 1, None), ("x", 2, 20)]
    assert joins.anti_join(a, b, na_matches="never").count() == 1


def test_mismatch_report_keeps_row_multiplicity_and_na_keys(spark):
    a = spark.createDataFrame([("S1",), ("S1",), (None,), ("S2",)], "sample string")
    b = spark.createDataFrame([("S2",), (None,), ("S3",)], "sample string")
    got = sorted((r.sample or "", r.side) for r in joins.mismatch_report(a, b).collect())
    assert got == [("S1", "left_only"), ("S1", "left_only"), ("S3", "right_only")]


def test_zero_fill_grid_of_many_cells(spark):
    obs = spark.range(300).selectExpr("concat('S', id % 7) sample", "concat('t', id) taxon", "id count")
    roster = spark.range(9).selectExpr("concat('S', id) sample", "id * 2 depth")
    out = joins.zero_fill_grid(obs, roster, ["sample"], ["taxon"], ["count"], block=4)
    assert out.count() == 2700 == out.select("sample", "taxon").distinct().count()
    assert out.where("count > 0").count() == 299 and out.where("depth is null").count() == 0
    assert out.where("sample = 'S3' and taxon = 't10'").first()["count"] == 10
    assert joins.zero_fill_grid(obs.limit(0), roster, ["sample"], ["taxon"], ["count"]).count() == 0


def test_zero_fill_grid_of_a_million_taxa(spark):
    obs = spark.range(1_000_000).selectExpr("'S0' sample", "id taxon", "1L count")
    roster = spark.range(10).selectExpr("concat('S', id) sample")
    out = joins.zero_fill_grid(obs, roster, ["sample"], ["taxon"], ["count"])
    assert tuple(out.selectExpr("count(*)", "sum(count)").first()) == (10_000_000, 1_000_000)
