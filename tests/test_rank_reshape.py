import math

from abundance.operators import reshape
from abundance.plans import pipelines as P


def test_model_report_cut_and_weights(spark):
    rows = [("r", "m0", 100.0), ("r", "m2b", 102.0), ("r", "m2a", 102.0), ("r", "m10", 110.0), ("r", "m1001", 110.01)]
    df = spark.createDataFrame(rows, "response string, modname string, aicc double")
    out = P.model_report(df).orderBy("cumsum_wi").collect()
    assert [r.modname for r in out] == ["m0", "m2a", "m2b", "m10"]
    w = [math.exp(-d / 2) for d in (0, 2, 2, 10, 10.01)]
    assert math.isclose(out[0].wi_aicc, w[0] / sum(w))
    assert out[-1].cumsum_wi < 1.0


def test_widen_fills_absent_only(spark):
    df = spark.createDataFrame([("S1", "a", 1), ("S1", "b", None), ("S2", "a", 2), ("S2", None, 4)],
                               "sample string, cls string, n long")
    got = {r.sample: r.asDict() for r in reshape.widen(df, ["sample"], "cls", "n", fill=0).collect()}
    assert got["S1"]["b"] is None and got["S2"]["b"] == 0 and got["S2"]["unclassified"] == 4


def test_lengthen_widen_identity(spark):
    df = spark.createDataFrame([("S1", "a", 1), ("S1", "b", 2), ("S2", "a", 3), ("S2", "b", 4)],
                               "sample string, cls string, n long")
    wide = reshape.widen(df, ["sample"], "cls", "n", levels=["a", "b"])
    back = reshape.lengthen(wide, ids=["sample"], names_to="cls", values_to="n")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_stack_named(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "y")], "x int, z string")
    got = sorted((r.x, r.z, r.name) for r in reshape.stack_named({"A": a, "B": b}).collect())
    assert got == [(1, None, "A"), (2, "y", "B")]
