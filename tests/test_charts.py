from abundance.operators import charts


def test_pretty_breaks():
    assert charts.pretty_breaks(1, 10, 5) == [0, 2, 4, 6, 8, 10]
    assert charts.pretty_breaks(0.0, 1.0, 5) == [0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0]


def test_hist_right_closed_empty_kept(spark):
    df = spark.createDataFrame([(v,) for v in [0.0, 2.0, 2.0, 4.0, 10.0]], "x double")
    got = [(r.lower, r.upper, r["count"]) for r in charts.hist_bins(df, "x").orderBy("bin").collect()]
    # R: hist(c(0,2,2,4,10)) -> breaks 0,2,...,10; counts 3 (incl. 0), 1, 0, 0, 1
    assert [c for _, _, c in got] == [3, 1, 0, 0, 1]


def test_rescale(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert [r.x_pos for r in charts.rescale(df, "x").collect()] == [0.0, 1.0, None]


def test_scatter_sample_is_the_same_rows_on_any_layout(spark):
    from abundance.operators.charts import scatter_sample
    df = spark.range(1000).selectExpr("id k", "case when id % 10 = 0 then null else id * 1.5 end x", "id % 7 y")
    a, b = (sorted(map(tuple, scatter_sample(df.repartition(n), "x", "y", ["k"], 50).collect())) for n in (1, 9))
    assert a == b and len(a) == 50
    assert scatter_sample(df, "x", "y", ["k"], 5000).count() == 900
