"""SentencePiece encoding and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundance.llm import piece_bpe, queries as Q
from test_text_ops import SF, table

MODEL = Q.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return piece_bpe.Codec(piece_bpe.load_spec(MODEL))


def ids_of(packed):
    return np.frombuffer(packed, "<i4").tolist()


def odd_texts():
    rnd = random.Random(4)
    odd = ["", " ", "  ", "a", " a", "a ", "\n", "\t\tx", "▁", "▁▁a", " " * 300, " " * 299 + "word" + " " * 33, "aaaa" * 100, "ab" * 400, "日本語テキスト", "😀😀 x",
           "\x00a", "é" * 500, "\r\n\r\n", "1234567890", "a b", "�", "x" * 5000, "<s>hello</s><unk><0x41>", "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(2000))]
    return odd + ["".join(rnd.choices("abcdefghinorstue  .,\n\t1▁", k=rnd.randrange(1, 700))) for _ in range(400)]


def test_equal_to_the_library(codec, library):
    texts = odd_texts()
    for text, packed in zip(texts, codec.encode(texts)):
        assert ids_of(packed) == library.encode(text), text[:80]
        assert codec.decode(packed) == library.decode(ids_of(packed))
    assert codec.encode([]) == []


def test_rounds_and_heap_give_the_same(codec, library, monkeypatch):
    texts = odd_texts()
    for short in (2, 10_000):
        monkeypatch.setattr(piece_bpe, "SHORT", short)
        codec.fresh()
        assert [ids_of(p) for p in codec.encode(texts)] == library.encode(texts)
    codec.fresh()


def test_decoding_any_ids(codec, library):
    rnd = random.Random(1)
    pools = (range(library.vocab_size()), [0, 1, 2, *range(3, 300)])
    for ids in [rnd.choices(pool, k=rnd.randrange(1, 12)) for pool in pools for _ in range(5000)]:
        assert codec.decode(np.array(ids, "<i4").tobytes()) == library.decode(ids)


def test_table_equals_the_library(spark, library):
    docs = dict(table(spark, "documents", "doc_id", "text"))
    rows = Q.op12_pieces(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, make_docs, library):
    df = make_docs([(1, None), (1, None), (2, ""), (None, "some words"), (3, "word " * 100_000)]).withColumn("IDS", F.lit("x"))
    rows = piece_bpe.decode(piece_bpe.encode(df, MODEL), MODEL).collect()
    assert [(r.doc_id, r.ids is None, r.decoded) for r in rows][:3] == [(1, True, None), (1, True, None), (2, False, "")]
    assert ids_of(rows[4].ids) == library.encode("word " * 100_000) and rows[3].decoded == "some words"
    assert piece_bpe.round_trip(df.limit(0), MODEL, digest="d").count() == 0
