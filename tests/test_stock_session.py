"""A stock local session, without any checkpoint setting, in its own process."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None
from abundance.operators import agg, rank
df = spark.range(50).selectExpr("id", "cast(id % 7 as string) g", "id * 1.5 x")
assert agg.describe_num(df, ["x"]).count() == 1
assert rank.category_order(df.groupBy("g").count(), "g", "count").count() == 7
assert rank.running_total(df, ["g"], ["id"], "id", bounded=False).count() == 50
print("done")
"""


def test_checkpoints_without_the_setting(tmp_path):
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path))
    env.pop("SPARK_LOCAL_DIRS", None)
    p = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], env=env, capture_output=True, text=True, timeout=300)
    assert p.returncode == 0 and "done" in p.stdout, p.stderr[-2000:]
