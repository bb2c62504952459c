"""One deployment holding a third of all rows: results stay exact, and the
hot key is handled by partial aggregation / AQE's skew-join split."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from abundance.operators import agg, joins, rank


def _skewed(spark, n=30000):
    rng = np.random.default_rng(5)
    sample = np.where(rng.random(n) < 1 / 3, "HOT", np.char.add("S", rng.integers(0, 500, n).astype(str)))
    pdf = pd.DataFrame({"sample": sample, "taxon": rng.choice(["a", "b", "c", "d"], n),
                        "count": rng.integers(0, 50, n), "w": rng.integers(0, 5, n),
                        "x": rng.integers(0, 6, n).astype(float)})
    return pdf, spark.createDataFrame(pdf).repartition(16)


def test_aggregates_exact_under_skew(spark):
    pdf, df = _skewed(spark)
    got = {(r.sample, r.taxon): r["count"] for r in agg.max_n(df, ["sample", "taxon"]).collect()}
    ref = pdf.groupby(["sample", "taxon"])["count"].max().to_dict()
    assert got == ref
    m = {r.sample: r.mean for r in agg.weighted_moments(df, ["sample"], "x", "w").collect()}
    pos = pdf[pdf.w > 0]
    ref_m = (pos.x * pos.w).groupby(pos["sample"]).sum() / pos.w.groupby(pos["sample"]).sum()
    assert all(abs(m[k] - v) < 1e-9 for k, v in ref_m.items())
    f = {r.sample: r.x for r in rank.first_by_min(df, ["sample"], "x", ["count"]).collect()}
    assert f == pdf.groupby("sample")["x"].min().to_dict()


def test_skewed_sort_merge_join_exact(spark):
    pdf, df = _skewed(spark)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        totals = agg.sum_counts(df, ["sample"], out="total")
        out = joins.natural_join(df.select("sample", "count"), totals, "inner", on=["sample"])
        assert out.count() == len(pdf)
        hot = out.where("sample = 'HOT'").select("total").distinct().collect()
        assert [r.total for r in hot] == [int(pdf[pdf["sample"] == "HOT"]["count"].sum())]
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_spread_join_deals_out_hot_and_missing_keys(spark):
    rows = spark.range(20000).selectExpr("case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end k", "id")
    table = spark.sql("select 7 k, 'seven' name union all select 11, 'eleven' union all select 8, 'eight' union all select null, 'none'")
    for how, n in (("left", 20000), ("inner", 6669), ("left_semi", 6669), ("left_anti", 13331)):
        out = joins.spread_join(rows, table, "k", how, share=100, salts=16)
        assert out.count() == n
    named = {(r.k, r.name): r.n for r in joins.spread_join(rows, table, "k", "left", share=100, salts=16).where("k in (7, 8, 11) or k is null")
             .groupBy("k", "name").agg(F.count("*").alias("n")).collect()}
    assert named == {(7, "seven"): 6667, (8, "eight"): 1, (11, "eleven"): 1, (None, None): 6667}
    assert joins.spread_join(rows.limit(0), table, "k").count() == 0
    # without adaptive execution and broadcast of the sides the hot key reaches several tasks
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = joins.spread_join(rows, table, "k", "inner", share=100, salts=16).where("k = 7").groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) > 2 and max(r["count"] for r in sizes) < 4000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_running_sums_over_a_group_that_fills_many_ranges(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["hot", "hot", "hot", "a", "b", None], 3000), "t": rng.permutation(3000),
                        "x": rng.integers(0, 9, 3000), "y": rng.random(3000)})
    df = spark.createDataFrame(pdf).withColumn("x", F.when(F.col("t") % 10 != 0, F.col("x")))
    got = rank.running_sums(df, ["g"], [F.col("t")], {"sx": "x", "n": F.lit(1)}, parts=7)
    plain = rank.running_total(df, ["g"], ["t"], "x", "sx")
    assert sorted((str(r.g), r.t, r.sx) for r in got.collect()) == sorted((str(r.g), r.t, r.sx) for r in plain.collect())
    last = {str(r.g): r.n for r in got.groupBy("g").agg(F.max("n").alias("n")).collect()}
    assert last == {str(k): v for k, v in pdf.g.fillna("None").value_counts().items()}
    assert rank.running_sums(df.limit(0), ["g"], [F.col("t")], {"n": F.lit(1)}).count() == 0
    all_one = rank.running_sums(df, [], [F.col("t").desc()], {"n": F.lit(1)}, parts=5)
    assert [r.n for r in all_one.orderBy(F.col("t").desc()).collect()] == list(range(1, 3001))


def test_group_total_of_a_hot_and_a_missing_group(spark):
    df = spark.range(4000).selectExpr("case when id % 3 = 0 then 'hot' when id % 7 = 1 then null else concat('g', id % 50) end g", "id % 2 h", "id x")
    a = rank.group_total(df, ["g", "h"], "x", "t", bounded=False)
    b = rank.group_total(df, ["g", "h"], "x", "t")
    assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
