"""Conversation prefix trie (operator 11).

Method: whole-sequence collapse. Every turn of a conversation gets a digest of
role and text; the sum of position-keyed hashes over the first d turns names
the prefix of length d, so two conversations share a node of the trie exactly
if they share that sum (four 32-bit lanes, packed in 128 bits). Identical
conversations are grouped first: a sequence carries its weight (number of
conversations), its smallest conversation and its end list. Only one
conversation of each sequence then makes prefixes. A sequence that is a proper
prefix of another is found by an anti-join with the proper prefixes; the
others are the leaves. Nodes are the prefixes grouped with their weights.

A node's saved tokens are what a batch saves that computes each prefix once:
(n_convs - 1) times the bytes of its last text, summed over its subtree. Each
node is given to one leaf below it (its smallest), sums run up the paths of
the leaves, and the path sums of a node's leaves add up to its subtree.

Scale: texts never move, only digests and lengths do. Grouping is by sums,
minima and counts, which combine before their shuffles, so the root and other
popular prefixes are a few rows per task. Positions and prefix sums are
two-level (``rank.running_sums``), so one conversation may hold any share of
the turns. Lookups of a hot conversation or a hot parent deal its rows out
(``joins.spread_join``). End lists are written in blocks of at most 512
ids; the digest of a list reads its blocks in order, one batch in memory at a
time (SHA-256 cannot be split, so a list is read by one task).

Defined cases: rows without conversation id belong to none and are left out.
Null role or text is empty. Rows are ordered by turn, null first; rows of one
turn (and repeated rows, which all count) by role and then by the digest of
their text. A conversation without turns (``members``) ends at the root. Other
columns are ignored, whatever their names. Without any conversation there is
no node. Two sequences are taken as equal if their 128-bit sums are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from abundance.llm.common import SLICE, shuffle_partitions
from abundance.operators.joins import spread_join
from abundance.operators.rank import running_sums
from abundance.session import cut_lineage

LANES = ["s1", "s2", "s3", "s4"]
KEY = ["k1", "k2"]
BLOCK_BITS = 9


def ordered_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, n_bytes): the turns of each conversation,
    numbered from 1, with the digest of role and text instead of the text."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), F.md5(said).alias("body"),
        F.octet_length(said).cast("long").alias("n_bytes")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "body", "row")]
    return running_sums(rows, ["conv_id"], order, {"pos": F.lit(1)}).select(
        "conv_id", "pos", F.md5(F.concat("role", F.lit("\n"), "body")).alias("digest"), "n_bytes")


def share_openings(turns: DataFrame, every: int = 5, lengths: int = 9) -> DataFrame:
    """Rebuild each conversation c: the first h turns of conversation
    c - c % ``every``, then its own turns after its first h, where h is the
    CRC-32 of the decimal id modulo ``lengths``. Takes and returns numbered
    turns (``ordered_turns``); positions are numbered anew."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(lengths)).cast("long")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")).withColumns(
        {"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    # At most `lengths` turns of a base and a few conversations on it: no key is hot.
    heads = turns.where(F.col("pos") < lengths).select(F.col("conv_id").alias("base"), "pos", "digest", "n_bytes")
    opened = convs.join(heads, "base").where("pos <= h").select("conv_id", "pos", "digest", "n_bytes")
    # The base has min(h, its length) turns; later turns move up when it has fewer than h.
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_len"))
    moved = convs.join(sizes, "base", "left").select(
        "conv_id", (F.col("h") - F.least("h", F.coalesce("base_len", F.lit(0)))).alias("gap"), F.col("own").alias("__n"))
    moved = cut_lineage(moved)
    own = turns.withColumn("h", h).where("pos > h").drop("h")
    kept = spread_join(own, moved.drop("__n"), "conv_id", "inner", counts=moved.select("conv_id", "__n"))
    return opened.unionByName(kept.select("conv_id", (F.col("pos") - F.col("gap")).alias("pos"), "digest", "n_bytes"))


def with_lanes(turns: DataFrame) -> DataFrame:
    """Each turn's position-keyed hash, as four sums' summands."""
    x1, x2 = (F.xxhash64(F.lit(k), "pos", "digest") for k in (1, 2))
    low = F.lit(0xFFFFFFFF)
    return turns.select("conv_id", "pos", "n_bytes", x1.bitwiseAND(low).alias("s1"), F.shiftrightunsigned(x1, 32).alias("s2"),
                        x2.bitwiseAND(low).alias("s3"), F.shiftrightunsigned(x2, 32).alias("s4"))


def packed(lanes: list[Column]) -> list[Column]:
    """Two longs that hold the lanes' sums modulo 2^32."""
    low = F.lit(0xFFFFFFFF)
    return [lanes[i].bitwiseAND(low).bitwiseOR(F.shiftleft(lanes[i + 1], 32)) for i in (0, 2)]


def whole_sequences(lanes: DataFrame, members: DataFrame) -> DataFrame:
    """(conv_id, n, k1, k2): the whole sequence of every conversation."""
    none = members.select("conv_id", F.lit(0).cast("long").alias("one"), *[F.lit(0).cast("long").alias(s) for s in LANES])
    rows = lanes.select("conv_id", F.lit(1).cast("long").alias("one"), *LANES).union(none)
    sums = rows.groupBy("conv_id").agg(F.sum("one").alias("n"), *[F.sum(s).alias(s) for s in LANES])
    return sums.select("conv_id", "n", *[c.alias(k) for c, k in zip(packed([F.col(s) for s in LANES]), KEY)])


def end_lists(whole: DataFrame) -> DataFrame:
    """(n, k1, k2, block, ids): the conversations of each sequence, ascending,
    as comma-joined texts of 2 ** ``BLOCK_BITS`` neighbouring ids at most."""
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("conv_id")), lambda x: x.cast("string")), ",")
    return whole.groupBy("n", *KEY, block).agg(ids.alias("ids"))


def end_digests(lists: DataFrame) -> DataFrame:
    """(n, k1, k2, ends_sha256) of end lists, read block by block."""
    import hashlib

    def run(batches):
        import pyarrow as pa

        now, h, done = None, None, []

        def flush():
            out = pa.RecordBatch.from_pylist([{**dict(zip(("n", *KEY), k)), "ends_sha256": d} for k, d in done], schema=kind)
            done.clear()
            return out

        kind = pa.schema([("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
        for cols in (b.slice(i, SLICE).to_pydict() for b in batches for i in range(0, b.num_rows, SLICE)):
            for key, ids in zip(zip(cols["n"], cols["k1"], cols["k2"]), cols["ids"]):
                if key == now:
                    h.update(b",")
                else:
                    if h is not None:
                        done.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256()
                h.update(ids.encode())
            if done:
                yield flush()
        if h is not None:
            done.append((now, h.hexdigest()))
            yield flush()

    sorted_blocks = lists.repartition(shuffle_partitions(lists.sparkSession), "n", *KEY).sortWithinPartitions("n", *KEY, "block")
    return sorted_blocks.select("n", *KEY, "ids").mapInArrow(run, T.StructType([
        *[T.StructField(c, T.LongType()) for c in ("n", *KEY)], T.StructField("ends_sha256", T.StringType())]))


def sequences(whole: DataFrame) -> DataFrame:
    """(n, k1, k2, rep, weight): each distinct sequence once."""
    return whole.groupBy("n", *KEY).agg(F.min("conv_id").alias("rep"), F.count("*").alias("weight"))


def prefixes(lanes: DataFrame, seqs: DataFrame) -> DataFrame:
    """(rep, weight, n, d, n_bytes, k1, k2, p1, p2): every non-empty prefix of
    each sequence, with the key of the prefix one turn shorter."""
    mine = spread_join(lanes, seqs.select(F.col("rep").alias("conv_id"), "weight", "n"), "conv_id", "inner",
                       counts=seqs.select(F.col("rep").alias("conv_id"), F.col("n").alias("__n")))
    sums = running_sums(mine, ["conv_id"], [F.col("pos")], {f"r{s}": s for s in LANES} | {"d": F.lit(1)})
    here = packed([F.col(f"r{s}") for s in LANES])
    before = packed([F.col(f"r{s}") - F.col(s) for s in LANES])
    return sums.select(F.col("conv_id").alias("rep"), "weight", "n", "d", "n_bytes", *[c.alias(k) for c, k in zip(here, KEY)],
                       *[c.alias(k) for c, k in zip(before, ("p1", "p2"))])


def prefix_trie(turns: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """One row per node: depth, k1, k2 (the node's key), conv_id (smallest
    member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    ``turns`` are numbered turns (``ordered_turns``, perhaps rebuilt);
    ``members`` (conv_id) names all conversations, for those without turns.
    The last turn of a node is turn ``depth`` of conversation ``conv_id``.
    """
    lanes = cut_lineage(with_lanes(turns))
    ids = (lanes if members is None else members).select("conv_id").where("conv_id is not null").distinct()
    whole = cut_lineage(whole_sequences(lanes, ids))
    seqs = cut_lineage(sequences(whole))
    paths = cut_lineage(prefixes(lanes, seqs))
    key = ["depth", *KEY]

    # Sequences that are proper prefixes of others are no leaves.
    zero = F.lit(0).cast("long")
    inner = paths.where("d < n").select(F.col("d").alias("n"), *KEY).union(
        paths.where("d = 1").select(zero, zero, zero)).distinct()
    leaves = cut_lineage(seqs.join(inner, ["n", *KEY], "left_anti").select("rep", "n"))
    counts = leaves.select("rep", F.col("n").alias("__n"))
    marked = spread_join(paths, leaves.select("rep", F.lit(True).alias("leaf")), "rep", "left", counts=counts)

    # The root is a prefix of every sequence; its rows are made from the sequences.
    root = seqs.join(leaves.select("rep", F.lit(True).alias("leaf")), "rep", "left").select(
        "rep", "weight", "n", zero.alias("d"), zero.alias("n_bytes"), zero.alias("k1"), zero.alias("k2"),
        F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "leaf")
    marked = cut_lineage(marked.select(root.columns).unionByName(root).withColumnRenamed("d", "depth"))
    nodes = cut_lineage(marked.groupBy(*key).agg(
        F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.max("n_bytes").alias("n_bytes"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min(F.when(F.col("leaf"), F.col("rep"))).alias("owner")))

    # Each node's own saving goes to its smallest leaf; sums run up every leaf's path.
    path = marked.where("leaf").select("rep", *key, zero.alias("own"))
    owned = nodes.select(F.col("owner").alias("rep"), "depth", F.lit(None).cast("long").alias("k1"), F.lit(None).cast("long").alias("k2"),
                         ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"))
    steps = path.union(owned).groupBy("rep", "depth").agg(F.max("k1").alias("k1"), F.max("k2").alias("k2"), F.sum("own").alias("own"))
    up = running_sums(steps, ["rep"], [F.col("depth").desc()], {"below": "own"})
    subtree = up.groupBy(*key).agg(F.count("*").alias("n_leaves"), F.sum("below").alias("saved_tokens"))

    # Children and parents.
    parent = [F.col("depth") - 1, F.col("p1"), F.col("p2")]
    children = cut_lineage(nodes.where("depth > 0").groupBy(*[c.alias(k) for c, k in zip(parent, key)]).agg(F.count("*").alias("n_children")))
    ends = end_digests(end_lists(whole)).withColumnRenamed("n", "depth")
    facts = nodes.join(subtree, key).join(children, key, "left").join(ends, key, "left")
    linked = facts.select("conv_id", "depth", *KEY, "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
                          F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), (F.col("depth") - 1).alias("__d"), "p1", "p2")
    above = nodes.select(F.col("depth").alias("__d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    fanout = children.select(F.col("depth").alias("__d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("n_children").alias("__n"))
    return spread_join(linked, above, ["__d", "p1", "p2"], "left", counts=fanout).drop("__d", "p1", "p2")


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes with the digest and length of their last turn (null at the root),
    from the numbered turns the trie was built on."""
    last = turns.select("conv_id", F.col("pos").alias("depth"), "digest", "n_bytes")
    return nodes.join(last, ["conv_id", "depth"], "left")
