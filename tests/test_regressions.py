"""Inputs on which earlier versions gave silent wrong answers or errors."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundance.models.glm import glm
from abundance.models.select import full_subsets
from abundance.operators import agg, reshape
from abundance.operators.charts import hist_bins
from abundance.session import checkpoint_dir
from abundance.sources.io import read_survey_csv
from abundance.streaming.maxn_stream import read_maxn


def test_csv_files_with_other_column_orders(spark, tmp_path):
    for name, text in {"a": "sample,count\nS1,3\nS2,4\n", "b b": "count,sample\n9,S3\n", "c": "sample,count\nS4,5\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    df = read_survey_csv(spark, str(tmp_path), types={"count": "int"})
    assert sorted((r["sample"], r["count"]) for r in df.collect()) == [("S1", 3), ("S2", 4), ("S3", 9), ("S4", 5)]


def test_weighted_sd_of_large_values(spark):
    df = spark.createDataFrame([("g", 1e9 + i, 1) for i in range(5)] + [("h", 1e9, 3), ("h", 1e9 + 1, 1), ("n", None, 2)], "k string, x double, w int")
    r = {x.k: x for x in agg.weighted_moments(df, ["k"], "x", "w").collect()}
    assert abs(r["g"].sd - np.std(np.arange(5), ddof=1)) < 1e-9 and r["g"]["mean"] == 1e9 + 2
    assert abs(r["h"].sd - 0.5) < 1e-9 and r["n"]["mean"] is None and r["n"].sd is None


def test_two_values_for_one_cell(spark):
    df = spark.createDataFrame([("S1", "a", 1), ("S1", "a", 7)], "sample string, cls string, n int")
    with pytest.raises(Exception, match="more than one value"):
        reshape.widen(df, ["sample"], "cls", "n", levels=["a"]).collect()
    assert reshape.widen(df, ["sample"], "cls", "n", levels=["a"], combine=F.sum).first()["a"] == 8


def test_stream_table_keeps_the_newest_update(spark, tmp_path):
    cols = "sample string, family string, genus string, species string, scientific string, count long"
    for batch, count in ((0, 5), (1, None)):
        spark.createDataFrame([("S1", "f", "g", "s", "f g s", count)], cols).write.parquet(str(tmp_path / f"batch_id={batch}"))
    assert read_maxn(spark, str(tmp_path)).first()["count"] is None


def test_steep_response_does_not_stop_the_job(spark):
    df = spark.createDataFrame([(float(i), 0) for i in range(39)] + [(39.0, 2000)], "x double, y int")
    f = glm(df, "y", ["x"])
    assert np.all(np.isfinite(f.coef)) and np.isfinite(f.deviance)
    assert f.df_null == 39 and f.df_residual == 38 and f.null_deviance > f.deviance


def test_wide_factor_equals_group_means(spark):
    rows = [(f"l{i % 60:02d}", (i * 7) % 11 + 1) for i in range(1200)]
    f = glm(spark.createDataFrame(rows, "g string, y int"), "y", ["g"])
    mean = {g: np.mean([y for h, y in rows if h == g]) for g in {g for g, _ in rows}}
    assert len(f.coef) == 60 and abs(f.coef[0] - np.log(mean["l00"])) < 1e-8
    assert all(abs(b - np.log(mean[n[1:]] / mean["l00"])) < 1e-8 for n, b in zip(f.names[1:], f.coef[1:]))


def test_one_overflowing_predictor_leaves_the_others_ranked(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    rows = [("r", float(v), float(w), float(rng.poisson(np.exp(0.5 + 0.4 * v)))) for v, w in zip(x, rng.normal(size=200))]
    rows[7] = ("r", rows[7][1], 1e160, rows[7][3])
    df = spark.createDataFrame(rows, "response string, a double, b double, y double")
    out = full_subsets(df, "y", ["a", "b"], max_size=2, cor_cutoff=2.0, smooth=False)
    ranked = {r.modname: r for r in out.models.collect()}
    failed = {r.modname for r in out.failed.collect()}
    assert "a" in ranked and set(ranked) | failed == {"null", "a", "b", "a+b"} and not set(ranked) & failed
    assert all(np.isfinite(r.importance) for r in out.importance.collect())


def test_one_histogram_bin(spark):
    r = hist_bins(spark.createDataFrame([(1.0,), (3.0,), (5.0,)], "x double"), "x", bins=1).collect()
    assert [(x["count"], x["lower"], x["upper"]) for x in r] == [(3, 1.0, 5.0)]


def test_model_inputs_keep_their_partitions(spark):
    from abundance.models.design import model_input
    df = spark.range(1000).repartition(37).select(F.col("id").alias("y"))
    kept = model_input(df, ["y"])
    assert kept.rdd.getNumPartitions() == 37
    kept.unpersist()


def test_status_filters_reach_the_scan(spark):
    from abundance.plans.queries import QUERIES
    for name in ("species_true_zeros", "max_n"):
        plan = QUERIES[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(l_linestatus,O)" in plan
        assert name == "max_n" or "In(o_orderstatus" in plan


def test_checkpoint_folder_is_read_from_the_session(spark):
    assert os.path.isabs(checkpoint_dir(spark).removeprefix("file:"))
