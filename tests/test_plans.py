"""Physical-plan properties the operators rely on (checked with explain)."""

import os
import tempfile

from abundance.operators import agg, clean, joins


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + "\n" + \
        df._jdf.queryExecution().optimizedPlan().toString()


def _formatted(df) -> str:
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _parquet(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="plans-"), "counts")
    rows = [(f"S{i % 7}", f"t{i % 5}", i % 9, "Yes" if i % 3 else "No", float(i)) for i in range(200)]
    spark.createDataFrame(rows, "sample string, taxon string, count long, successful_count string, extra double") \
        .write.parquet(d)
    return spark.read.parquet(d)


def test_keep_in_pushed_to_parquet(spark):
    df = clean.keep_in(_parquet(spark), "successful_count", ["Yes"])
    text = _formatted(df)
    assert "PushedFilters" in text and "successful_count" in text.split("PushedFilters")[1].split("\n")[0]


def test_exclude_with_na_pushed(spark):
    df = clean.exclude_values(_parquet(spark), "taxon", ["t1", None, ""])
    line = _formatted(df).split("PushedFilters")[1].split("\n")[0]
    assert "IsNotNull(taxon)" in line and "taxon" in line


def test_projection_pruned(spark):
    df = agg.max_n(_parquet(spark), ["sample", "taxon"])
    schema = _formatted(df).split("ReadSchema: ")[1].split("\n")[0]
    assert "extra" not in schema and "count" in schema


def test_max_n_partial_aggregation(spark):
    text = _formatted(agg.max_n(_parquet(spark), ["sample", "taxon"]))
    assert text.count("HashAggregate") >= 2 and "partial_max" in text


def test_null_safe_join_is_equi_join(spark):
    a = _parquet(spark).select("sample", "taxon", "count")
    b = agg.max_n(a, ["sample"], out="m")
    plan = _plan(joins.natural_join(a, b, "left", on=["sample"]))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "<=>" in plan or "coalesce" in plan


def test_non_nullable_key_uses_plain_equality(spark):
    a = spark.range(5).withColumnRenamed("id", "k")            # non-nullable
    b = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")
    out = joins.natural_join(a, b, "left", on=["k"])
    assert "<=>" not in _plan(out)
    assert sorted((r.k, r.v) for r in out.collect()) == [(0, None), (1, "x"), (2, None), (3, None), (4, None)]


def test_first_by_min_has_no_window_sort(spark):
    df = _parquet(spark)
    from abundance.operators import rank
    text = _formatted(rank.first_by_min(df, ["sample"], "extra"))
    assert "Window" not in text
