"""Operators that checkpoint, in a stock local session without any setting."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None
from abundance.llm import pii, simhash
docs = spark.createDataFrame([(1, "write to a.b@c.org now"), (2, "nothing here"), (3, "nothing here")], "doc_id long, text string")
assert sorted((r.doc_id, len(r.spans)) for r in pii.find(docs).collect()) == [(1, 1), (2, 0), (3, 0)]
assert {{r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}} == {{1: 1, 2: 2, 3: 2}}
print("done")
"""


def test_checkpoints_without_the_setting(tmp_path):
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path))
    p = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], env=env, capture_output=True, text=True, timeout=300)
    assert p.returncode == 0 and "done" in p.stdout, p.stderr[-2000:]
