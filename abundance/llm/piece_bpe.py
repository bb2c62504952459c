r"""SentencePiece encoding and decoding (operator 12).

Encodes and decodes as a SentencePiece BPE model with byte fallback does.

Method: vectorised merge rounds. The words of a batch of texts that are not in
the cache are laid end to end in one numpy array of symbols. In each round the
rank of every pair of neighbours is known, the smallest rank of each word is
found by a segmented minimum, all pairs of that rank are merged at once
(of overlapping ones the leftmost first), the array is compacted, the
ranks beside the merges are refreshed and finished words leave; until no pair
remains.

Merging all pairs of a rank at once gives what merging one by one gives unless
a merged piece can join a neighbour at a rank as small or smaller. Such pieces
(and those that share their score with others) are known from the vocabulary;
a word whose smallest rank is of that kind merges only its leftmost pair in
that round. Words of ``SHORT`` symbols and more, for which rounds over the
whole word would be quadratic, merge in the same order with a heap.

Words. No piece holds a space mark behind another character, so no merge
crosses the start of a run of space marks behind a word, nor a character that
no longer piece contains; texts are cut there. Each task keeps the ids of
short words in a dict, emptied at ``CACHE`` entries.

The model file is read on the driver and its pieces (a vocabulary, so of
bounded size) are broadcast; workers build their tables once. No shuffle.

Defined cases: null text gives null ids and null decoded text (no ids and
empty text with ``null_as_empty``); empty text gives no ids. Texts are encoded
whole. Other columns pass through; input columns named like an output are
replaced. Rows are independent, so ties and repeated rows need no rule, and an
empty table gives an empty table. Decoding ids outside the vocabulary is an
error. Models other than BPE with byte fallback and identity normalisation
are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
from pyspark.sql import DataFrame, types as T

from abundance.llm.common import map_rows, worker_store

SHORT = 256
CACHE = 150_000
GROUP = 1 << 22         # characters whose words are encoded together
SPACE = "▁"        # the space mark of SentencePiece
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6    # piece types of the model format
NONE = np.int64(1) << 40


def messages(data: bytes):
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


def load_spec(path: str) -> bytes:
    """What workers need of a model file, as compact JSON."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, trainer, norm = [], {}, {}
    for field, value in messages(data):
        if field == 1:
            p = dict(messages(value))
            pieces.append([p[1].decode(), float(np.frombuffer(p.get(2, bytes(4)), "<f4")[0]), p.get(3, NORMAL)])
        elif field == 2:
            trainer = dict(messages(value))
        elif field == 3:
            norm = dict(messages(value))
    kinds = {k for _, _, k in pieces}
    # Numbers of the model format's fields: trainer 3 model type (2: BPE), 35
    # byte fallback, 24 spaces as suffix, 44 text of unknown ids; normaliser 2
    # character map, 3 dummy prefix, 4 extra spaces removed, 5 spaces marked.
    if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or kinds & {USER_DEFINED, UNUSED}:
        raise ValueError("only BPE models with byte fallback and identity normalisation are supported")
    if any(SPACE in p.lstrip(SPACE) for p, _, k in pieces if k == NORMAL):
        raise ValueError("a piece spans words")
    return json.dumps({"pieces": pieces, "prefix": bool(norm.get(3, 1)), "unknown": trainer.get(44, b" \xe2\x81\x87 ").decode()}).encode()


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, spec: bytes):
        import re

        t = json.loads(spec)
        self.prefix = t["prefix"]
        score = {p: s for p, s, k in t["pieces"] if k == NORMAL}
        self.byte_ids = np.full(256, -1, np.int32)
        ident = {}
        for i, (p, _, k) in enumerate(t["pieces"]):
            if k == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
            elif k == NORMAL:
                ident[p] = i
        # Symbols: the pieces, then the characters that are no piece themselves.
        letters = sorted({c for p in score for c in p})
        self.names = list(score) + [c for c in letters if c not in score]
        number = {p: i for i, p in enumerate(self.names)}
        self.ids = np.array([ident.get(p, -1) for p in self.names], np.int32)
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in letters:
            self.of_char[ord(c)] = number[c]
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in score.items()}
        shared = np.bincount(list(rank.values())) > 1
        # Pairs (left symbol, right symbol) -> rank and merged symbol.
        found, single = [], np.array([bool(shared[rank[p]]) if p in rank else False for p in self.names])
        for p, r in rank.items():
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is not None and b is not None:
                    found.append((a * len(self.names) + b, r, number[p]))
                    for x in (a, b):  # a part that could be made after this piece had joined it
                        if rank.get(self.names[x], -1) >= r:
                            single[x] = True
        found.sort()
        self.keys, self.ranks, self.merged = (np.array(c, np.int64) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        self.one_at_a_time = np.zeros(len(order), bool)
        for p, r in rank.items():
            self.one_at_a_time[r] |= single[number[p]]
        self.pairs = {k: (r, m) for k, r, m in found}
        longer = {c for p in score if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in longer and c != 32)
        self.words = re.compile(f" *[^ {alone}]+|[{alone}]| +" if alone else " *[^ ]+| +").findall
        # Decoding.
        self.text_of = ["" if k in (CONTROL, BYTE) else t["unknown"] if k == UNKNOWN else p.replace(SPACE, " ") for p, _, k in t["pieces"]]
        self.is_byte = np.array([k == BYTE for _, _, k in t["pieces"]])
        self.spaced = np.array([k == NORMAL and p.startswith(SPACE) for p, _, k in t["pieces"]])
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_ids) if i >= 0}
        self.cache = {}

    def fresh(self) -> Codec:
        self.cache.clear()
        return self

    def lookup(self, left, right):
        """(rank, merged symbol) of pairs; rank ``NONE`` where there is none."""
        if not len(self.keys):
            return np.full(len(left), NONE), np.zeros(len(left), np.int64)
        key = left * len(self.names) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def merge_rounds(self, symbols, starts):
        """Merge flat symbols (int64) of words that begin at ``starts`` until
        no pair remains; gives the symbols left and the word of each, by word."""
        word = np.zeros(len(symbols), np.int64)
        word[starts[1:]] = 1
        word = np.cumsum(word)
        place, characters = np.arange(len(symbols)), symbols     # place of a symbol's first character
        rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)

        def refresh(at):
            at = at[(at >= 0) & (at + 1 < len(symbols))]
            at = at[word[at] == word[at + 1]]
            rank[at], made[at] = self.lookup(symbols[at], symbols[at + 1])

        refresh(np.arange(len(symbols) - 1))
        done = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(first, len(symbols)))
            least = np.minimum.reduceat(rank, first)
            over = np.repeat(least == NONE, sizes)
            if over.any():
                done.append((word[over], place[over], symbols[over]))
                going = ~over
                word, place, symbols, rank, made = (x[going] for x in (word, place, symbols, rank, made))
                sizes, least = sizes[least < NONE], least[least < NONE]
                if not len(symbols):
                    break
            candidate = np.flatnonzero(rank == np.repeat(least, sizes))
            # Leftmost of overlapping pairs: every second one of a run of neighbours.
            fresh = np.concatenate(([True], np.diff(candidate) != 1))
            offset = np.arange(len(candidate)) - np.maximum.accumulate(np.where(fresh, np.arange(len(candidate)), 0))
            chosen = offset % 2 == 0
            careful = self.one_at_a_time[rank[candidate]]
            if careful.any():
                opens = np.concatenate(([True], np.diff(word[candidate]) != 0))
                chosen &= ~careful | opens
            at = candidate[chosen]
            symbols = symbols.copy()
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            word, place, symbols, rank, made = (x[stay] for x in (word, place, symbols, rank, made))
            at = moved[at]
            rank[at] = NONE
            rank[at[at > 0] - 1] = NONE
            refresh(np.unique(np.concatenate((at - 1, at))))
        if not done:
            return characters, word, place
        word, place, symbols = (np.concatenate(c) for c in zip(*done))
        by = np.argsort(place, kind="stable")
        return symbols[by], word[by], place[by]

    def merge_long(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(place, symbol) of one long word: the same order of merges (rank,
        then leftmost) from a heap."""
        n, size, get = len(symbols), len(self.names), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(i):
            j = after[i]
            return get(symbols[i] * size + symbols[j]) if j < n and symbols[i] >= 0 and symbols[j] >= 0 else None

        gone = [False] * n
        heap = [(p[0], i, symbols[i], symbols[i + 1], p[1]) for i in range(n - 1) if (p := pair(i))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], after[i] = merged, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (p := pair(x)):
                    heapq.heappush(heap, (p[0], x, symbols[x], symbols[after[x]], p[1]))
        return [(i, x) for i, x in enumerate(symbols) if not gone[i]]

    def ids_of(self, symbols, places, characters):
        """(ids, how many per symbol): pieces as their id, other characters as
        their bytes' ids."""
        ids = np.where(symbols >= 0, self.ids[symbols], -1)
        unknown = np.flatnonzero(ids < 0)
        if not len(unknown):
            return ids, np.ones(len(ids), np.int64)
        code = characters[places[unknown]]
        raw = [self.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in code.tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[unknown] = [len(r) for r in raw]
        out = np.repeat(ids, counts)
        out[np.repeat(ids < 0, counts)] = np.concatenate(raw)
        return out, counts

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words (space marks as spaces), little-endian int32 each."""
        out = [b""] * len(words)
        short = [i for i, w in enumerate(words) if len(w) < SHORT]
        if short:
            codes = np.frombuffer("".join([words[i] for i in short]).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = np.array([len(words[i]) for i in short])
            symbols, word, place = self.merge_rounds(self.of_char[codes].astype(np.int64), np.cumsum(sizes) - sizes)
            ids, counts = self.ids_of(symbols, place, codes)
            ends = np.cumsum(np.bincount(word, counts, len(short)).astype(np.int64)) * 4
            packed, at = ids.astype("<i4").tobytes(), 0
            for i, end in zip(short, ends.tolist()):
                out[i], at = packed[at:end], end
        for i, w in enumerate(words):
            if len(w) >= SHORT:
                codes = np.frombuffer(w.replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), "<u4")
                left = np.array(self.merge_long(self.of_char[codes].tolist()), np.int64)
                out[i] = self.ids_of(left[:, 1], left[:, 0], codes)[0].astype("<i4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text (no text is None)."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= GROUP:
                out += self.encode_group(group)
                group, size = [], 0
        return out + self.encode_group(group)

    def encode_group(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE:
            self.cache.clear()
        cut = [self.words((" " if self.prefix and t else "") + t.replace(SPACE, " ")) for t in texts]
        cache = self.cache
        new = list({w for words in cut for w in words if w not in cache})
        made = dict(zip(new, self.encode_words(new)))
        for w, ids in made.items():
            if len(w) <= 64:
                cache[w] = ids
        get = made.get
        return [b"".join([cache[w] if w in cache else get(w) for w in words]) for words in cut]

    def utf8(self, raw: bytes) -> str:
        """Bytes as text; each byte outside a valid sequence is U+FFFD."""
        try:
            return raw.decode()
        except UnicodeDecodeError as e:
            return raw[:e.start].decode() + "�" + self.utf8_rest(raw[e.start + 1:])

    def utf8_rest(self, raw: bytes) -> str:
        out = []
        while raw:
            try:
                return "".join(out) + raw.decode()
            except UnicodeDecodeError as e:
                out.append(raw[:e.start].decode() + "�")
                raw = raw[e.start + 1:]
        return "".join(out)

    def decode(self, packed: bytes) -> str:
        """The text of packed ids. The space of the dummy prefix goes."""
        ids = np.frombuffer(packed, "<i4")
        if not len(ids):
            return ""
        listed, is_byte = ids.tolist(), self.is_byte[ids]
        if is_byte.any():
            cuts = np.flatnonzero(np.diff(is_byte.astype(np.int8))) + 1
            edges = [0, *cuts.tolist(), len(listed)]
            parts, bytes_now = [], bool(is_byte[0])
            for a, b in zip(edges, edges[1:]):
                parts.append(self.utf8(bytes([self.byte_of[i] for i in listed[a:b]])) if bytes_now else "".join([self.text_of[i] for i in listed[a:b]]))
                bytes_now = not bytes_now
            text = "".join(parts)
        else:
            text = "".join([self.text_of[i] for i in listed])
        lead = next((i for i in listed if self.is_byte[i] or self.text_of[i]), None)
        return text[1:] if self.prefix and lead is not None and self.spaced[lead] else text


def worker_codec(spec: bytes, digest: str) -> Codec:
    store = worker_store()
    if ("piece", digest) not in store:
        store["piece", digest] = Codec(spec)
    return store["piece", digest].fresh()


def with_codec(df: DataFrame, model_path: str, column: str, fields: list[T.StructField], convert) -> DataFrame:
    spec = load_spec(model_path)
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


def packed_ids(codec: Codec, texts: list, null: bytes | None) -> list:
    some = iter(codec.encode([t for t in texts if t is not None]))
    return [null if t is None else next(some) for t in texts]


def encode(df: DataFrame, model_path: str, text: str = "text", out: str = "ids", null_as_empty: bool = False) -> DataFrame:
    """Add ``out`` (binary): the text's ids, little-endian int32 each."""
    null = b"" if null_as_empty else None
    return with_codec(df, model_path, text, [T.StructField(out, T.BinaryType())], lambda codec, texts: [packed_ids(codec, texts, null)])


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` (string): the text of packed ids."""
    return with_codec(df, model_path, ids, [T.StructField(out, T.StringType())],
                      lambda codec, packed: [[None if x is None else codec.decode(x) for x in packed]])


def round_trip(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", out: str = "decoded", digest: str | None = None,
               null_as_empty: bool = False) -> DataFrame:
    """``encode`` and then ``decode`` of the ids in one pass of one worker.
    ``digest`` names a column for the SHA-256 of the decimal ids, joined by
    commas (null for null ids)."""
    null = b"" if null_as_empty else None
    fields = [T.StructField(ids, T.BinaryType()), T.StructField(out, T.StringType())]
    if digest:
        fields.append(T.StructField(digest, T.StringType()))

    def both(codec, texts):
        packed = packed_ids(codec, texts, null)
        found = [packed, [None if x is None else codec.decode(x) for x in packed]]
        if digest:
            decimal = worker_store().setdefault("decimal", [str(i) for i in range(len(codec.text_of))])
            found.append([None if x is None else hashlib.sha256(",".join([decimal[i] for i in np.frombuffer(x, "<i4").tolist()]).encode()).hexdigest() for x in packed])
        return found

    return with_codec(df, model_path, text, fields, both)
