"""Conversation prefix trie: the query against brute force, and odd rows."""

import os
import random

from pyspark.sql import functions as F

import brute
from abundance.llm import prefix_trie as trie, queries as Q
from test_text_ops import SF

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id long, turn long, role string, text string"


def as_rows(df):
    return sorted((tuple(r) for r in df.select(*NODE).collect()), key=str)


def of_table(spark, tmp_path, rows, parts=3):
    folder = f"{tmp_path}/t{random.random()}"
    spark.createDataFrame(rows, TURNS).repartition(parts).write.parquet(f"{folder}/conversations.parquet")
    return as_rows(Q.op11_prefix_trie(spark, folder))


def test_table_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_rows(Q.op11_prefix_trie(spark, SF)) == brute.prefix_nodes(rows)


def test_copies_prefixes_and_odd_rows(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "é"])) for c in range(60) for t in range(rnd.randrange(1, 9))]
    rows += [(100, t, "user", "same") for t in range(30)] + [(105, t, "user", "same") for t in range(30)]
    rows += [(200 + c, t, "user", "copy") for c in range(40) for t in range(4)]
    rows += [(300, None, None, None), (300, None, "user", ""), (300, 1, "", "x"), (300, 1, "", "x"), (None, 1, "user", "nobody's"), (-7, 0, "user", "a"), (-5, 0, "user", "b")]
    rows += [(301, 0, "a\nb", "c"), (302, 0, "a", "b\nc"), (400, 0, "user", "long " * 40000)]
    rnd.shuffle(rows)
    assert of_table(spark, tmp_path, rows) == brute.prefix_nodes(rows)


def test_no_rows_and_clashing_names(spark, tmp_path):
    assert of_table(spark, tmp_path, []) == []
    df = spark.createDataFrame([(1, 0, "u", "a", "x", 5)], TURNS + ", pos string, k1 int")
    nodes = trie.prefix_trie(trie.ordered_turns(df))
    assert sorted((r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in nodes.collect()) == [(1, 0, 1, 1), (1, 1, 1, 1)]
    turns = trie.ordered_turns(df)
    assert {(r.depth, r.n_bytes) for r in trie.node_turns(nodes, turns).collect()} == {(0, None), (1, 1)}


def test_members_without_turns_end_at_the_root(spark):
    members = spark.range(3000).withColumnRenamed("id", "conv_id")
    nodes = trie.prefix_trie(trie.ordered_turns(spark.createDataFrame([(5, 0, "user", "hi")], TURNS)), members)
    root = nodes.where("depth = 0").first()
    ids = ",".join(str(c) for c in range(3000) if c != 5)
    assert (root.n_convs, root.n_children, root.n_leaves) == (3000, 1, 1)
    assert root.ends_sha256 == spark.createDataFrame([(ids,)], "x string").select(F.sha2("x", 256)).first()[0]
