"""One small invented campaign through the reader and the workflows, with
numbers worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from abundance.operators import agg, clean
from abundance.plans import pipelines as P
from abundance.sources.io import read_survey_csv

ROSTER = """campaignid,sample,site,depth_m,latitude_dd,longitude_dd,date_time,successful_count,successful_length,video location
bay-2031,A1,North,1.0,-31.5,115.1,2031-03-01T08:15:00+08:00,Yes,Yes,shed
bay-2031,A2,North,2.5,-31.5,115.2,2031-03-01T09:15:00+08:00,Yes,No,shed
bay-2031,A3,South,4.0,NIL,115.3,2031-03-02T00:05:00+08:00,No,No,NIL
bay-2031,A4,South,8.5,-31.7,115.4,2031-03-02T23:55:00+08:00,Yes,Yes,shed
"""
HABITAT = """sample,stone,mean_relief
A1,0.10,0.5
A2,0.40,1.5
A3,0.80,2.0
A4,0.90,4.0
"""


@pytest.fixture()
def meta(spark, tmp_path):
    (tmp_path / "roster.csv").write_text(ROSTER)
    return read_survey_csv(spark, str(tmp_path / "roster.csv"), sentinels=("NA", "NIL"),
                           types={"depth_m": "double", "latitude_dd": "double", "longitude_dd": "double"})


def test_shape_names_and_sentinels(meta):
    assert meta.count() == 4 and "video_location" in meta.columns
    assert meta.where(F.col("latitude_dd").isNull()).count() == 1
    assert meta.where(F.col("video_location").isNull()).count() == 1


def test_success_flags_and_sites(meta):
    yes = {c: meta.where(F.col(c) == "Yes").count() for c in ["successful_count", "successful_length"]}
    assert yes == {"successful_count": 3, "successful_length": 2}
    assert {r.site: r["count"] for r in meta.groupBy("site").count().collect()} == {"North": 2, "South": 2}


def test_local_dates_from_offset_text(meta):
    m = clean.split_local_datetime(meta, "date_time")
    assert {r.date: r["count"] for r in m.groupBy("date").count().collect()} == {"2031-03-01": 2, "2031-03-02": 2}


def test_depth_summary(meta):
    r = agg.describe_num(meta, ["depth_m"]).first()
    assert (r.min, r.q1, r.median, r["mean"], r.q3, r.max) == (1.0, 2.125, 3.25, 4.0, 5.125, 8.5)


def test_roster_keeps_successful(meta):
    assert P.deployment_roster(meta).count() == 3


def test_correlation_and_summary(spark, tmp_path):
    (tmp_path / "habitat.csv").write_text(HABITAT)
    h = read_survey_csv(spark, str(tmp_path / "habitat.csv"), types={"stone": "double", "mean_relief": "double"})
    r = agg.correlation(h, "stone", "mean_relief").first().r
    assert math.isclose(r, 1.45 / math.sqrt(0.41 * 6.5), abs_tol=1e-12)
    s = agg.describe_num(h, ["stone"]).first()
    assert math.isclose(s["mean"], 0.55) and math.isclose(s.median, 0.6)
