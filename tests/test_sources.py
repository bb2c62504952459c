import os
import tempfile

import pytest

from abundance.sources.io import Campaign, load_table, read_survey_csv, read_tsv_with_preamble, save_table


def _tmp():
    return tempfile.mkdtemp(prefix="abundance-test-")


def test_csv_sentinels_and_text_timestamp(spark):
    d = _tmp()
    p = os.path.join(d, "meta.csv")
    with open(p, "w") as f:
        f.write('sample,date_time,depth_m,observer_count,Video location\n')
        f.write('S1,2025-04-23T07:38:00+08:00,2.5,NIL,""\n')
        f.write('S2,2025-04-23T10:38:00+08:00,NA,Alex,\n')
        f.write('S3,2025-04-24T10:38:00+08:00,bad,NA,P1\n')
    df = read_survey_csv(spark, p, types={"depth_m": "double"}, sentinels=("NA", "NIL"))
    rows = {r.sample: r for r in df.collect()}
    assert df.columns == ["sample", "date_time", "depth_m", "observer_count", "video_location"]
    assert rows["S1"].date_time == "2025-04-23T07:38:00+08:00"      # stays local text (T1)
    assert rows["S1"].observer_count is None and rows["S3"].observer_count is None
    assert rows["S2"].depth_m is None and rows["S3"].depth_m is None and rows["S1"].depth_m == 2.5
    df2 = read_survey_csv(spark, p, sentinels=("NA", "NIL"), blank_as="")
    assert {r.sample: r.video_location for r in df2.collect()}["S2"] == ""


def test_tsv_preamble_two_files(spark):
    d = _tmp()
    for name, nl in (("a.txt", "\n"), ("b.txt", "\r\n")):
        with open(os.path.join(d, name), "w", newline="") as f:
            f.write(nl.join(["pre 1", "pre 2", "pre 3", "pre 4", "CampaignID\tOpCode\tBroad",
                             f"c1\t{name}1\tSand", f"c1\t{name}2\tUnknown"]) + nl)
    df = read_tsv_with_preamble(spark, d, skip=4)
    assert df.columns == ["campaign_id", "op_code", "broad"]
    assert sorted(r.op_code for r in df.collect()) == ["a.txt1", "a.txt2", "b.txt1", "b.txt2"]


def test_save_load_campaign_partition(spark):
    root = _tmp()
    c1, c2 = Campaign("c1", root), Campaign("c2", root)
    save_table(spark.createDataFrame([(1,)], "x int"), c1, "t")
    save_table(spark.createDataFrame([(2,)], "x int"), c2, "t")
    save_table(spark.createDataFrame([(3,)], "x int"), c1, "t")      # replaces c1 only
    assert [r.x for r in load_table(spark, c1, "t").collect()] == [3]
    assert sorted(r.x for r in load_table(spark, c1, "t", all_campaigns=True).collect()) == [2, 3]
    assert c1.raw("count").endswith("raw/c1_count.csv")


def test_write_csv_drops_column(spark):
    from abundance.sources.io import write_csv
    out = os.path.join(_tmp(), "fits")
    df = spark.createDataFrame([("r", "m", 1.0)], "response string, modname string, aicc double")
    write_csv(df, out, drop=["modname"], single_file=True)
    back = spark.read.option("header", True).csv(out)
    assert back.columns == ["response", "aicc"] and back.count() == 1


def test_tsv_lines_do_not_depend_on_the_number_of_tasks(spark, monkeypatch):
    d = _tmp()
    for k in range(6):
        with open(os.path.join(d, f"f{k}.txt"), "w") as f:
            f.write("pre\n" * 4 + "\n" + "id\tv\n" + "".join(f"{k}-{i}\t{i}\n" for i in range(350)))
    old = {c: spark.conf.get(c, None) for c in ("spark.sql.files.minPartitionNum", "spark.sql.files.openCostInBytes")}
    try:
        for before, after in ((1, 8), (8, 1)):
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            spark.conf.set("spark.sql.files.minPartitionNum", str(before))
            df = read_tsv_with_preamble(spark, d)
            spark.conf.set("spark.sql.files.minPartitionNum", str(after))        # as when executors come or go
            assert df.count() == 2100 and df.where("id rlike '^[0-9]-[0-9]+$'").count() == 2100
    finally:
        for c, v in old.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_tsv_in_many_blocks(spark):
    d = _tmp()
    with open(os.path.join(d, "f.txt"), "w") as f:
        f.write("pre\npre\n" + "id\tv\n" + "".join(f"r{i}\t{i}\n" for i in range(30)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "80")
        assert sorted(r.id for r in read_tsv_with_preamble(spark, d, skip=2).collect()) == sorted(f"r{i}" for i in range(30))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40")
        with pytest.raises(ValueError):
            read_tsv_with_preamble(spark, d, skip=20)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_points_on_a_curve_prune_row_groups(spark):
    import glob

    import pyarrow.parquet as pq

    from abundance.operators.clean import within_bbox
    from abundance.sources.io import save_points
    df = spark.range(200_000).selectExpr("id", "pmod(hash(id), 36000) / 100.0 - 180 lon", "pmod(hash(id + 7), 18000) / 100.0 - 90 lat")
    path = save_points(df, os.path.join(_tmp(), "points"), "lon", "lat", group_bytes=32_000, files=8)
    extent = ((100, 136), (-40, -22))                                   # a hundredth of the globe
    assert within_bbox(spark.read.parquet(path), "lon", "lat", *extent).count() == within_bbox(df, "lon", "lat", *extent).count() > 0
    read = groups = 0
    for f in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            groups += 1
            read += all(float(cols[k].max) >= lo and float(cols[k].min) <= hi for k, (lo, hi) in zip(("lon", "lat"), extent))
    assert groups > 40 and read < groups / 10
    odd = spark.createDataFrame([(1, None, 2.0), (2, 500.0, -95.0), (3, float("nan"), 0.0)], "id int, lon double, lat double")
    assert spark.read.parquet(save_points(odd, os.path.join(_tmp(), "odd"), "lon", "lat")).count() == 3
