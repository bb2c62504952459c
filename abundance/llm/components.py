"""Connected components of a distributed edge list.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) on DataFrames: every step is one
``min`` aggregate per node, combined before its shuffle, and one join that
brings the minimum back to the node's edges (the edges of a node that holds
many are dealt out, ``joins.spread_join``). The number of rounds grows with the
logarithm of the nodes, the edge list never grows, and each round is cut off by
a written table, so a lost executor costs a re-read. Nothing is collected but a
count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from abundance.operators.joins import spread_join
from abundance.session import write_table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node with an edge to another node; root is the
    component's smallest node. Nulls and self-links are ignored, repeated and
    reversed edges count once."""
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    e, last = write_table(e), None
    while (now := _mark(e)) != last:
        last = now
        if not now[0]:
            break
        e = write_table(_small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _to_least(rows: DataFrame, low: DataFrame) -> DataFrame:
    """The rows with their node's minimum ``m``."""
    low = write_table(low)
    return spread_join(rows, low.select("u", "m"), "u", "inner", counts=low.select("u", "__n"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("__n"))
    return _to_least(both.where("v > u"), low).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__n"))
    near = _to_least(e, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()
