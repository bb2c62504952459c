r"""Byte-level BPE encoding and decoding (operator 7).

Method: a contiguous rank array. A word (a piece of the pre-tokenizer's
pattern) is held as the ids of its parts, one per boundary, beside an array
with the merge rank of each adjacent pair. The smallest rank is found by a
scan, its boundary deleted, and the two neighbouring ranks refreshed. Scans
cost the square of the word's length, which is the fastest way for words of
a few dozen bytes; longer words (``SHORT`` parts and more) use a heap over a
linked list with the same order of merges, so one very long run of letters
costs n log n.

The tokenizer file is parsed on the driver; its merges (a vocabulary, so of
bounded size) are broadcast, and each worker builds its tables from them once.
A task keeps the encodings of short words in a dict that is emptied when it
reaches ``CACHE`` entries, and drops it at its end, as idle workers stay alive.

Defined cases: null text gives null ids and null decoded text (``encode`` with
``null_as_empty`` gives no ids instead); empty text gives no ids. Texts are
encoded whole. The text of a special token is encoded as that token, as the
tokenizers library does by default. Other columns pass through; input columns
named like an output are replaced. Rows are independent, so ties and repeated
rows need no rule, and an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json

from pyspark.sql import DataFrame, types as T

from abundance.llm.common import map_rows, worker_store

SHORT = 256
CACHE = 150_000
# Pattern of the byte-level pre-tokenizer (a fixed value of this tokenizer
# family); \p{White_Space} is the white space its regex engine means by \s.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary:
    itself where printable, else the next free code point from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_spec(path: str) -> bytes:
    """What workers need of a tokenizers JSON file, as compact JSON."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    m, pre = t["model"], t.get("pre_tokenizer") or {}
    if m.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or t.get("normalizer") or pre.get("add_prefix_space"):
        raise ValueError("only byte-level BPE files without normalizer and prefix space are supported")
    merges = [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
    added = [[a["content"], a["id"]] for a in t.get("added_tokens", [])]
    return json.dumps({"vocab": m["vocab"], "merges": merges, "added": added}).encode()


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary."""

    def __init__(self, spec: bytes):
        import regex

        t = json.loads(spec)
        vocab, letters = t["vocab"], byte_letters()
        # Pair of ids -> (rank << 32 | merged id): the smallest value is the next merge.
        self.pairs = {}
        for rank, (a, b) in enumerate(t["merges"]):
            self.pairs.setdefault((vocab[a], vocab[b]), rank << 32 | vocab[a + b])
        self.byte_id = [0] * 256
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        self.bytes_of = {i: bytes(letters[c] for c in w) for w, i in vocab.items()}
        self.special = {w: i for w, i in t["added"]}
        self.bytes_of |= {i: w.encode() for w, i in self.special.items()}
        self.words = regex.compile(PATTERN).findall
        tokens = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, tokens)) + ")").split if tokens else None
        codec = self

        class Cache(dict):
            def __missing__(self, word):
                ids = codec.merge(word.encode())
                packed = b"".join(i.to_bytes(4, "little") for i in ids)
                if len(word) <= 64:
                    self[word] = packed
                return packed

        self.cache = Cache()

    def fresh(self) -> Codec:
        """This codec with an empty cache."""
        self.cache.clear()
        return self

    def merge(self, word: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in word]
        if len(ids) >= SHORT:
            return self.merge_long(ids)
        get, none = self.pairs.get, 1 << 62
        ranks = [get(p, none) for p in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            ids[i] = best & 0xFFFFFFFF
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges (smallest rank, then leftmost) from a heap."""
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the parts has been merged since
            ids[i], ids[j], after[i] = r & 0xFFFFFFFF, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (q := get((ids[x], ids[after[x]]))) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[after[x]]))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        get = self.cache.__getitem__
        if self.cut is None:
            return b"".join(map(get, self.words(text)))
        parts = []
        for piece in self.cut(text):
            if piece in self.special:
                parts.append(self.special[piece].to_bytes(4, "little"))
            else:
                parts.extend(map(get, self.words(piece)))
        return b"".join(parts)

    def decode(self, packed: bytes) -> str:
        import numpy as np

        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in np.frombuffer(packed, "<u4").tolist()]).decode("utf-8", "replace")


def worker_codec(spec: bytes, digest: str) -> Codec:
    store = worker_store()
    if ("bpe", digest) not in store:
        store["bpe", digest] = Codec(spec)
    return store["bpe", digest].fresh()


def with_codec(df: DataFrame, tokenizer_path: str, column: str, fields: list[T.StructField], convert) -> DataFrame:
    """Add ``fields`` by ``convert(codec, values) -> lists``, one per field."""
    spec = load_spec(tokenizer_path)
    digest, shared = hashlib.sha256(spec).hexdigest(), df.sparkSession.sparkContext.broadcast(spec)

    def make():
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        codec, kinds = worker_codec(shared.value, digest), [to_arrow_type(f.dataType) for f in fields]

        def run(a):
            return [pa.array(v, k) for v, k in zip(convert(codec, a.to_pylist()), kinds)]

        run.done = codec.cache.clear
        return run

    return map_rows(df, column, fields, make)


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "ids", null_as_empty: bool = False) -> DataFrame:
    """Add ``out`` (binary): the text's token ids, little-endian uint32 each."""
    null = b"" if null_as_empty else None
    return with_codec(df, tokenizer_path, text, [T.StructField(out, T.BinaryType())],
                      lambda codec, texts: [[null if t is None else codec.encode(t) for t in texts]])


def decode(df: DataFrame, tokenizer_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (string): the text of packed ids, special tokens included.
    Ids outside the vocabulary give nothing; bytes that are not UTF-8 give
    U+FFFD."""
    return with_codec(df, tokenizer_path, ids, [T.StructField(out, T.StringType())],
                      lambda codec, packed: [[None if x is None else codec.decode(x) for x in packed]])


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", out: str = "decoded", null_as_empty: bool = False) -> DataFrame:
    """``encode`` and then ``decode`` of the ids, in one pass of one worker."""
    null = b"" if null_as_empty else None

    def both(codec, texts):
        packed = [null if t is None else codec.encode(t) for t in texts]
        return [packed, [None if x is None else codec.decode(x) for x in packed]]

    return with_codec(df, tokenizer_path, text, [T.StructField(ids, T.BinaryType()), T.StructField(out, T.StringType())], both)
