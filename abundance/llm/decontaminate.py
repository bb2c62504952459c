r"""Benchmark decontamination (operator 10).

Method: one Aho-Corasick automaton over the normalised benchmark items. Text
and items are normalised alike (A-Z lower-cased, words are runs of characters
outside ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``). The automaton's alphabet is the
benchmark's vocabulary: a document is scanned once as a sequence of word
numbers, every word outside the vocabulary being number 0. Its patterns are
the items' aligned blocks of ``(width + 1) // 2`` words (7 of 13), as any window
of ``width`` words holds a whole block; around a block found, the words of
document and item are compared, up to a window's reach on either side, and
where they agree over ``width`` words or more the windows occur. That takes one
automaton node per word of the benchmark, where a pattern per window takes
``width``. An item with fewer words than a window (but not none) is one
pattern. Word offsets are mapped back to code points of the original text for
documents that have a match.

Scale: documents are never shuffled. The items reach the workers as broadcasts
whose size is measured first: items are dealt into blocks of at most
``block_bytes`` of text (or one item), one automaton each. With one block there
is a single pass. With several, a task joins its rows to groups of
``GROUP_BYTES`` and scans a group once per block, so one automaton is held at a
time; beside it a worker keeps the blocks' texts. README gives the memory.

Defined cases: null or empty text has no words and no hits; items without
words are never found; an item id may repeat (its rows are one item) and an
item without id counts for hits but not in ``items``. Repeated document rows
are judged one by one. Input columns named like an output are replaced. An
empty benchmark gives no hits; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from abundance.llm.common import as_bytes, drop_clashes, map_rows, worker_store

GROUP_BYTES = 32 << 20
WORD_IN_TEXT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # before lower-casing


def normalising_table() -> bytes:
    """Byte by byte: A-Z to lower case, separators to a space. Bytes of
    non-ASCII characters (0x80 and above) are word characters."""
    t = bytearray(range(256))
    for b in range(128):
        low = b + 32 if 0x41 <= b <= 0x5A else b
        t[b] = low if 0x30 <= low <= 0x39 or 0x61 <= low <= 0x7A else 0x20
    return bytes(t)


class Scanner:
    """Automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int):
        import ahocorasick

        table = normalising_table()
        self.width, self.block = width, (width + 1) // 2
        self.number, self.names, self.words, places = {}, [], [], {}
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in text.translate(table).split()]
            if not ids:
                continue
            size = self.block if len(ids) >= width else len(ids)
            for k in range(0, len(ids) - size + 1 if size == self.block else 1, size):
                places.setdefault(tuple(ids[k:k + size]), []).append((len(self.names), k))
            self.names.append(item)
            self.words.append(np.array(ids, np.int32))
        self.any = bool(places)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        self.size, self.first, where = [], [], []
        while places:                       # emptied as it is read: the patterns are held once
            key, at = places.popitem()
            self.automaton.add_word(key, len(self.size))
            self.size.append(len(key))
            self.first.append(len(where))
            where.extend(at)
        self.first.append(len(where))
        self.where = np.array(where, np.int32).reshape(-1, 2)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Words that a window covers, as flags (None: none), and the items."""
        if not self.any or not words:
            return None, set()
        get = self.number.get
        ids = tuple([get(w, 0) for w in words])
        steps, found, n = None, set(), len(ids)
        for end, k in self.automaton.iter(ids):
            size = self.size[k]
            for i, p in self.where[self.first[k]:self.first[k + 1]].tolist():
                item = self.words[i]
                a, b = end - size + 1, end + 1
                if len(item) >= self.width:
                    reach = self.width - size
                    q, stop = p, max(0, p - reach)
                    while q > stop and a > 0 and item[q - 1] == ids[a - 1]:
                        q, a = q - 1, a - 1
                    q, stop = p + size, min(len(item), p + size + reach)
                    while q < stop and b < n and item[q] == ids[b]:
                        q, b = q + 1, b + 1
                    if b - a < self.width:
                        continue
                if steps is None:
                    steps = np.zeros(n + 1, dtype=np.int64)
                steps[a] += 1
                steps[b] -= 1
                found.add(self.names[i])
        return (None if steps is None else np.cumsum(steps[:-1]) > 0), found


def item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items as pickled blocks of bounded size, fetched one at a time."""
    b = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("length(t) > 0")
    n = b.agg(F.sum(F.length("t")).alias("n")).first()["n"] or 0
    blocks = int(-(-n // block_bytes)) or 1
    for k in range(blocks):
        part = b if blocks == 1 else b.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        yield pickle.dumps([(r["i"], bytes(r["t"])) for r in part.toLocalIterator()])


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", width: int = 13, block_bytes: int = 16 << 20) -> DataFrame:
    """Add to every document: ``n_words``, ``n_hit`` (words inside an
    occurrence of a window), ``items`` (array of the item ids found, as
    strings) and ``spans`` (array of struct<start,end> in code points of the
    original text, end exclusive: maximal runs of hit words)."""
    sc = docs.sparkSession.sparkContext
    shared = [(hashlib.sha256(b).hexdigest(), sc.broadcast(b)) for b in item_blocks(benchmark, item_id, item_text, block_bytes)]
    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
              T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)]
    word_in_text = WORD_IN_TEXT

    def make():
        import re

        import pyarrow as pa

        store, table = worker_store(), normalising_table()
        find = re.compile(word_in_text).finditer

        def scanner(k):  # one automaton is held at a time when there are several
            digest, data = shared[k]
            if store.get("decontaminate", (None,))[0] != (digest, width):
                store["decontaminate"] = ((digest, width), Scanner(pickle.loads(data.value), width))
            return store["decontaminate"][1]

        def run(array):
            texts = as_bytes(array)
            counts, hits, items = [0] * len(texts), [None] * len(texts), [set() for _ in texts]
            for k in range(len(shared)):
                s = scanner(k)
                for i, t in enumerate(texts):
                    words = t.translate(table).split() if t else []
                    counts[i] = len(words)
                    flags, found = s.scan(words)
                    if flags is not None:
                        hits[i] = flags if hits[i] is None else hits[i] | flags
                        items[i] |= found
            spans = []
            for t, flags in zip(texts, hits):
                if flags is None:
                    spans.append([])
                    continue
                at = [m.span() for m in find(t.decode())]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in zip(edge[::2], edge[1::2])])
            spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return [pa.array(counts, pa.int64()), pa.array([0 if f is None else int(f.sum()) for f in hits], pa.int64()),
                    pa.array([sorted(x for x in s if x is not None) for s in items], pa.list_(pa.string())), pa.array(spans, spans_type)]

        return run

    return map_rows(docs, text, fields, make, GROUP_BYTES if len(shared) > 1 else 0)


def flag(found: DataFrame, share: int = 20) -> DataFrame:
    """Add ``contaminated``: some word is hit and hit words are at least one
    in ``share`` of the document's words."""
    return drop_clashes(found, ["contaminated"]).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    held = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    return flag(find_contamination(held, benchmark, **how)).where(~F.col("contaminated")).select("row.*")
