r"""Exact substring dedup by fixed-block anchors (operator 8).

Words are runs of characters outside ASCII white space, unchanged. A window is
``width`` (35) consecutive words of one document; every word covered by a
window whose word sequence also starts anywhere else is removed.

Method. Each document is a reference: its words are cut into non-overlapping
blocks of ``(width + 1) // 2`` words (18), and the blocks' hashes are the
index. Any window of 35 words contains a whole block, so if two places share a
window, a rolling 18-word window of the one place equals a block of the other.
Hence:

1. every rolling block-long window of every document probes the index; a probe
   is a hit if a block has its hash and the hash has two places or more;
2. hits are extended: each ``width``-word window around a hit is identified by
   110 bits of hash over its words (64 and 46) and counted over the corpus.
   Windows with two places are repeats, and runs of them are the maximal exact
   repeats;
3. their words are removed.

A copy is never paired with its copies, so a passage in a third of all
documents costs as much as any other text.

Scale. Documents are dealt into chunks of about ``CHUNK_BYTES`` by a hash of
(id, text), in one shuffle that all three steps read. A chunk sends each
distinct hash once (hot passages are combined before the shuffle), packed into
one binary block per bucket: 6 bytes a probe (46 bits of the hash beside the
bucket, and two flags); a chance meeting only makes a candidate that step 2
rejects. The answer is one bit per probe. Windows take 14 bytes, and a chunk is
told the first hash (8 bytes) of those of its own windows that repeat. Chunks and buckets are as many as the
input has chunk sizes (and at least the shuffle partitions), so a task's memory
stays bounded by the chunk or the longest document. A row that is repeated more
than ``MANY`` times is sent once with its count (it then has two places) and
its result is repeated at the end.

Defined cases: null or empty text has no words. Documents of under ``width``
words keep all. Repeated rows are separate places, so whole rows that repeat
remove each other like other copies. Only the id and text are read, so other
columns cannot clash; null ids are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from abundance.llm.common import as_bytes, hashed_bucket, run_starts, shuffle_partitions
from abundance.operators.joins import spread_join
from abundance.session import cut_lineage

CHUNK_BYTES = 8 << 20
MANY = 1000
BROADCAST_ROWS = 1_000_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so invertible modulo 2^64
KEY_BITS = np.uint64((1 << 46) - 1)


class WordHash(dict):
    """64-bit hashes of words; emptied when large."""

    def __missing__(self, word):
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Polynomial hashes modulo 2^64 of all windows of some words."""

    def __init__(self, base: int):
        self.base, self.back = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def windows(self, h: np.ndarray, size: int) -> np.ndarray:
        n = len(h)
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m, self.base))), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m, self.back))), dtype=np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.up[:n], dtype=np.uint64)))
        x = (total[size:] - total[:-size]) * self.down[:n - size + 1]
        x ^= x >> np.uint64(32)  # a multiply-and-shift finish spreads the bits
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket by the high bits: hashes in order have buckets in order."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


class Chunk:
    """The words of a chunk's documents as hashes."""

    def __init__(self, table, width: int):
        self.width, self.block = width, (width + 1) // 2
        hashes, self.roll = WordHash(), [Rolling(b) for b in BASES]
        self.docs = [hashes.of(t.split()) if t else np.zeros(0, np.uint64) for t in as_bytes(table.column("text"))]
        # A repeated row has two places.
        self.long = [d for d, n in zip(self.docs, table.column("copies").to_pylist()) if len(d) >= width for _ in range(min(n, 2))]

    def probes(self):
        """Distinct hashes of the rolling block-long windows in order, whether
        each has two places here, whether it is a block; and per long document
        the index of each window's hash."""
        if not self.long:
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool), []
        each = [self.roll[0].windows(d, self.block) for d in self.long]
        keys, where, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        where = np.split(where, np.cumsum([len(x) for x in each])[:-1])
        block = np.zeros(len(keys), bool)
        for w in where:
            block[w[::self.block]] = True
        return keys, count > 1, block, where

    def around(self, hit: np.ndarray, where: list) -> np.ndarray:
        """Two hashes each (n, 2) of the windows that contain a hit."""
        out = [np.zeros((0, 2), np.uint64)]
        reach = self.width - self.block + 1
        for d, w in zip(self.long, where):
            at = np.concatenate(([0], np.cumsum(hit[w])))
            at = at[reach:] > at[:-reach]
            if at.any():
                out.append(np.stack([r.windows(d, self.width)[at] for r in self.roll], axis=1))
        return np.concatenate(out)

    def removed(self, repeats: np.ndarray) -> list[np.ndarray]:
        """Per document, flags of the words that a repeated window covers.
        ``repeats``: first hashes, in order, of this chunk's repeated windows."""
        out = []
        for d in self.docs:
            steps = np.zeros(len(d) + 1, np.int64)
            if len(d) >= self.width and len(repeats):
                h = self.roll[0].windows(d, self.width)
                at = np.flatnonzero(repeats[np.minimum(np.searchsorted(repeats, h), len(repeats) - 1)] == h)
                np.add.at(steps, at, 1)
                np.add.at(steps, at + self.width, -1)
            out.append(np.cumsum(steps[:-1]) > 0)
        return out


def unique_rows(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of (n, 2) in order, and their counts."""
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return x[starts], np.diff(np.append(starts, len(x)))


def by_bucket(bucket: np.ndarray, rows: np.ndarray, chunk: int):
    """One (bucket, chunk, bytes) row per bucket of rows in bucket order."""
    import pyarrow as pa

    cuts = run_starts(bucket).tolist()
    ends = cuts[1:] + [len(rows)]
    return pa.table({"bucket": pa.array(bucket[cuts].astype(np.int64), pa.int64()), "chunk": pa.array([chunk] * len(cuts), pa.int32()),
                     "packed": pa.array([rows[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary())})


def chunk_of(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int, bool]:
    """(doc_id, text, copies, chunk), the number of chunks, and whether some
    row stands for many."""
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    size = src.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(shuffle_partitions(docs.sparkSession), -(-size // CHUNK_BYTES))
    name = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))]
    keyed = src.withColumns({f"k{i}": F.xxhash64(F.lit(i), *name) for i in (1, 2)})
    often = cut_lineage(keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies")).where(F.col("copies") > MANY))
    rows = often.count()
    if rows:
        told = keyed.join(F.broadcast(often), ["k1", "k2"], "left") if rows <= BROADCAST_ROWS else spread_join(
            keyed, often, ["k1", "k2"], "left", counts=often.withColumnRenamed("copies", "__n"))
        once = told.where("copies is not null").groupBy("k1", "k2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("copies").alias("copies"))
        src = told.where("copies is null").select("doc_id", "text", F.lit(1).cast("long").alias("copies")).unionByName(once.drop("k1", "k2"))
    else:
        src = src.withColumn("copies", F.lit(1).cast("long"))
    return src.withColumn("chunk", hashed_bucket(n, F.col("doc_id"), F.col("text"))), n, bool(rows)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 35) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (the kept
    words joined by one space) and repeats (array of struct<start,end>: the
    maximal removed word ranges, end exclusive)."""
    chunks, n, repeated = chunk_of(docs, doc_id, text)
    sent = "bucket long, chunk int, packed binary"

    def probe(key, table):
        keys, many, block, _ = Chunk(table, width).probes()
        entry = (keys & KEY_BITS) << np.uint64(2) | many.astype(np.uint64) << np.uint64(1) | block.astype(np.uint64)
        return by_bucket(bucket_of(keys, n), entry.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], key[0].as_py())

    def answer(table):
        import pyarrow as pa

        parts = table.column("packed").to_pylist()
        size = np.array([len(p) // 6 for p in parts])
        wide = np.zeros((size.sum(), 8), np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 6)
        entry = wide.view("<u8").ravel()
        order = np.argsort(entry >> np.uint64(2), kind="stable")
        e = entry[order]
        starts = run_starts(e >> np.uint64(2))
        flags = np.bitwise_or.reduceat(e & np.uint64(3), starts)
        count = np.diff(np.append(starts, len(e)))
        good = ((flags & np.uint64(1)) > 0) & ((count > 1) | ((flags & np.uint64(2)) > 0))
        hit = np.empty(len(e), bool)
        hit[order] = np.repeat(good, count)
        bits = np.split(hit, np.cumsum(size)[:-1])
        some = pa.array([i for i, b in enumerate(bits) if b.any()], pa.int64())
        return table.select(["bucket", "chunk"]).take(some).append_column(
            "packed", pa.array([np.packbits(bits[i]).tobytes() for i in some.to_pylist()], pa.binary()))

    def extend(key, docs_table, answers):
        c = Chunk(docs_table, width)
        keys, _, _, where = c.probes()
        bucket = bucket_of(keys, n)
        hit = np.zeros(len(keys), bool)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("packed").to_pylist()):
            i, j = np.searchsorted(bucket, [b, b + 1])
            hit[i:j] = np.unpackbits(np.frombuffer(bits, np.uint8), count=j - i).astype(bool)
        rows, count = unique_rows(c.around(hit, where) if hit.any() else np.zeros((0, 2), np.uint64))
        rows[:, 1] = (rows[:, 1] & KEY_BITS) << np.uint64(1) | (count > 1)
        return by_bucket(bucket_of(rows[:, 0], n), rows.astype("<u8").view(np.uint8).reshape(-1, 16)[:, :14], key[0].as_py())

    def count_windows(table):
        import pyarrow as pa

        parts = table.column("packed").to_pylist()
        size = [len(p) // 14 for p in parts]
        wide = np.zeros((sum(size), 16), np.uint8)
        wide[:, :14] = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 14)
        h = wide.view("<u8")
        second = h[:, 1] >> np.uint64(1)
        order = np.lexsort((second, h[:, 0]))
        a, b = h[order, 0], second[order]
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        count = np.diff(np.append(starts, len(a)))
        good = (count > 1) | (np.bitwise_or.reduceat(h[order, 1] & np.uint64(1), starts) > 0)
        hit = np.empty(len(a), bool)
        hit[order] = np.repeat(good, count)
        cuts = np.cumsum(size)[:-1]
        out = [p[m].tobytes() for p, m in zip(np.split(h[:, 0], cuts), np.split(hit, cuts))]
        some = pa.array([i for i, x in enumerate(out) if x], pa.int64())
        return pa.table({"chunk": table.column("chunk").take(some), "packed": pa.array([out[i] for i in some.to_pylist()], pa.binary())})

    def cut(key, docs_table, repeats):
        import pyarrow as pa

        texts = as_bytes(docs_table.column("text"))
        flags = Chunk(docs_table, width).removed(np.unique(np.frombuffer(b"".join(repeats.column("packed").to_pylist()), "<u8")))
        kept, spans = [], []
        for t, f in zip(texts, flags):
            words = t.split() if t else []
            kept.append(b" ".join([w for w, x in zip(words, f.tolist()) if not x] if f.any() else words))
            edge = np.flatnonzero(np.diff(np.concatenate(([0], f.astype(np.int8), [0])))).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2])])
        return pa.table({"doc_id": docs_table.column("doc_id"), "n_words": pa.array([len(f) for f in flags], pa.int64()),
                         "n_removed": pa.array([int(f.sum()) for f in flags], pa.int64()),
                         "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                         "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                         "copies": docs_table.column("copies")})

    out = T.StructType([chunks.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")] + [
        T.StructField("kept_text", T.StringType()),
        T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), T.StructField("copies", T.LongType())])
    by_chunk = chunks.groupBy("chunk")
    hits = by_chunk.applyInArrow(probe, sent).groupBy("bucket").applyInArrow(answer, sent)
    candidates = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(extend, sent)
    repeats = candidates.groupBy("bucket").applyInArrow(count_windows, "chunk int, packed binary")
    done = by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(cut, out)
    if repeated:        # in two steps, so that no array is long
        done = done.withColumn("more", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(copies - 1) div 1000"))))
        done = done.withColumn("more", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(1000), F.col("copies") - 1000 * F.col("more")))))
    return done.select("doc_id", "n_words", "n_removed", "kept_text", "repeats")
