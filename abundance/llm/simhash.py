r"""SimHash near-duplicates by multi-index hashing (operator 9).

A document's words (A-Z lower-cased, split at ASCII white space) give
``shingle``-word shingles, repeats included; each is hashed by XXH64 with seed
42 (UTF-8, joined by single spaces), and a bit of the 64-bit fingerprint is
set if it is set in over half of the hashes.

Method: fingerprints are cut into two 32-bit segments. Two fingerprints within
4 bits agree to within 2 bits in one of the segments, and then some 32-bit
value lies within 1 bit of both. So every distinct fingerprint enumerates the
Hamming ball of radius 1 of each segment (33 values) as table keys; those that
meet under a key are the candidates, and their complete distance is verified.
Splitting the radius of 2 between the two sides costs 66 keys per fingerprint
where a ball on one side alone would cost 529 a segment, and keys of 32 bits
keep chance meetings rare (a fingerprint meets about 2000 N / 2^32 others).

Scale: equal fingerprints are grouped first (a group of exact copies is one
fingerprint from then on), and texts are read once, never shuffled. Keys
travel packed: each task sends one binary block to each of the table's
buckets, 16 bytes an entry. Within a key's members, links are searched
breadth-first from the smallest fingerprint against those not yet reached, and
only the links that reach something new are kept (a spanning forest), so a
crowd of near copies gives as many links as members, never all pairs, and no
link between components is lost. Components come from ``components``; the
rows of a frequent fingerprint and of a large component are dealt out where
they are joined to their component's id (``joins.spread_join``).

Defined cases: null and empty texts have the fingerprint zero, which links
like any other. Documents without id are grouped like others; their
component's smallest id counts (null if the whole component has none).
Repeated rows are repeated in the result. Only the id and text columns are
read, so other columns cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from abundance.llm.common import SLICE, as_bytes, run_starts, shuffle_partitions
from abundance.llm.components import connected_components
from abundance.operators.joins import spread_join
from abundance.session import cut_lineage

BUCKET_ENTRIES = 1 << 20  # table entries that a bucket is planned for


def fingerprint(text: bytes | None, shingle: int) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = np.fromiter([h(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1:].tolist())], "<u8", n)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 4096):
        ones += np.unpackbits(hashes[k:k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. No shuffle."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([src.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = [fingerprint(t, shingle) for k in range(0, b.num_rows, SLICE) for t in as_bytes(b.column(1).slice(k, SLICE))]
            signed = np.array(fps, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signed, pa.int64())], names=["doc_id", "fp"])

    return src.mapInArrow(run, schema)


def ball_keys(fps: np.ndarray) -> np.ndarray:
    """(n, 66) table keys of unsigned fingerprints: for each 32-bit segment
    the values within 1 bit of it. Bit 32 says which segment."""
    flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(32, dtype=np.uint64)))
    low, high = fps & np.uint64(0xFFFFFFFF), fps >> np.uint64(32)
    return np.concatenate((low[:, None] ^ flips, (high[:, None] ^ flips) | np.uint64(1 << 32)), axis=1)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    return (mixed * np.uint64(n)) >> np.uint64(32)


def forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links within ``bits`` that span the components of some distinct
    fingerprints: breadth-first, each member compared with those not reached."""
    links, rest = [], members
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                reached, rest = rest[near], rest[~near]
                links.extend((int(x), int(y)) for y in reached)
                queue.extend(reached)
    return links


def links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """(a, b): links among distinct fingerprints (column ``fp``) that lie
    within ``bits`` bits, enough of them to connect what is connected."""
    if not 0 <= bits <= 5:
        raise ValueError("two segments with balls of radius 1 find distances of up to 5 bits")
    n = max(shuffle_partitions(fps.sparkSession), -(-fps.count() * 66 // BUCKET_ENTRIES))

    def deal(batches):
        import pyarrow as pa

        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(values), 20_000):
                own = values[k:k + 20_000]
                keys = ball_keys(own).ravel()
                bucket = bucket_of(keys, n)
                order = np.argsort(bucket, kind="stable")
                packed = np.stack((keys[order], np.repeat(own, 66)[order]), axis=1)
                cuts = run_starts(bucket[order]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[order][cuts].astype(np.int64)),
                     pa.array([packed[i:j].tobytes() for i, j in zip(cuts, cuts[1:] + [len(packed)])], pa.binary())], names=["bucket", "entries"])

    def meet(table):
        import pyarrow as pa

        e = np.frombuffer(b"".join(table.column("entries").to_pylist()), np.uint64).reshape(-1, 2)
        e = e[np.lexsort((e[:, 1], e[:, 0]))]
        keys, values = e[:, 0], e[:, 1]
        starts = run_starts(keys)
        ends = np.append(starts[1:], len(keys))
        size = ends - starts
        two = starts[size == 2]
        close = np.bitwise_count(values[two] ^ values[two + 1]) <= bits
        a, b = [values[two][close]], [values[two + 1][close]]
        for i, j in zip(starts[size > 2].tolist(), ends[size > 2].tolist()):
            found = forest(values[i:j], bits)
            if found:
                pairs = np.array(found, dtype=np.uint64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        pairs = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0].view(np.int64) if len(pairs) else np.zeros(0, np.int64), pa.int64()),
                         "b": pa.array(pairs[:, 1].copy().view(np.int64) if len(pairs) else np.zeros(0, np.int64), pa.int64())})

    dealt = fps.select("fp").mapInArrow(deal, "bucket long, entries binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lower-case hex digits)
    and component_id (the smallest doc_id reachable over links, itself
    included)."""
    fps = cut_lineage(fingerprints(docs, doc_id, text, shingle))
    groups = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("__n")))
    comp = connected_components(links(groups, bits))
    rooted = cut_lineage(groups.join(comp, groups["fp"] == comp["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")))
    least = cut_lineage(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("__n")))
    of_fp = spread_join(rooted.select("fp", "root"), least.drop("__n"), "root", "inner", counts=least.drop("component_id")).select("fp", "component_id")
    whole = spread_join(fps, of_fp, "fp", "inner", counts=groups.select("fp", "__n"))
    return whole.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """The documents whose id is the smallest of their component, with all
    their columns. A document is its id: rows that repeat an id stay or go
    together, and so do rows without id (they stay if some component of them
    has no id at all)."""
    found = near_duplicates(docs, doc_id, text, shingle, bits)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__stay")).distinct()
    return docs.join(stay, docs[doc_id].eqNullSafe(F.col("__stay")), "left_semi")
