"""BPE, substring, SimHash and decontamination against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from abundance.llm import bpe, decontaminate, queries as Q, simhash, substring
from abundance.llm.components import connected_components

SF = "/root/testdata/sf0.001"


def table(spark, name, *cols):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*cols).collect()]


def odd_docs(seed=0):
    """Copies, near copies, shared passages, periodic, empty, null and long texts, repeated rows."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdeé", k=rnd.randint(1, 4)))
    passage = [word() for _ in range(60)]
    docs = [(None, "no id " * 20), (None, None), (1, None), (2, ""), (3, " \t\n "), (4, "a " * 90), (4, "a " * 90), (5, "x y " * 40)]
    for i in range(10, 40):
        w = [word() for _ in range(rnd.choice([3, 30, 36, 80, 200]))]
        if i % 3 == 0:
            k = rnd.randint(0, len(w))
            w[k:k] = passage[rnd.randint(0, 20):rnd.randint(30, 60)]
        docs.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    base = [word() for _ in range(120)]
    for i in range(50, 70):
        w = list(base)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    docs.append((99, " ".join(word() for _ in range(5000))))
    return docs


def test_bpe_equals_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t for _, t in table(spark, "documents", "doc_id", "text")]
    rnd = random.Random(1)
    texts += ["", " ", "a<|endoftext|>b <|endoftext|><|endoftext|>", "it's I'll 12345  x\n\n\ty    \x1c\x1f\x85z", "a" * 5000, "ab" * 3000 + "!" * 999,
              "".join(chr(rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x250, 0xD800), rnd.randrange(0x10000, 0x20000)])) for _ in range(3000))]
    texts += ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3000, 64)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.json")
    once = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.round_trip(df, path).collect()}
    for r in bpe.decode(bpe.encode(df, path), path).collect():
        assert once[r["doc_id"]] == (r["ids"], r["decoded"])
        want = tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want, repr(texts[r["doc_id"]][:80])
        assert r["decoded"] == tok.decode(want, skip_special_tokens=False)


def test_bpe_long_words_merge_like_short_ones():
    import public_tokenizers

    codec = bpe.Codec(bpe.load_spec(public_tokenizers.path("byte_bpe_50k.json")))
    rnd = random.Random(2)
    for _ in range(300):
        w = bytes(rnd.choices(b"etaoinab ", k=rnd.randint(1, 60)))
        assert codec.merge(w) == codec.merge_long([codec.byte_id[b] for b in w])


def test_bpe_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (2, "", "y")], "doc_id long, text string, IDS string")
    rows = bpe.encode(df, Q.tokenizer_file("byte_bpe_50k.json")).orderBy("doc_id").collect()
    assert [bytes(r["ids"]) if r["ids"] is not None else None for r in rows] == [None, None, b""]
    assert bpe.decode(bpe.encode(df.limit(0), Q.tokenizer_file("byte_bpe_50k.json")), Q.tokenizer_file("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_substring_equals_brute(spark, make_docs, seed):
    docs = odd_docs(seed)
    for width in (35, 12):
        got = substring.remove_repeats(make_docs(docs).repartition(3), width=width).collect()
        assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == brute.remove_repeats(docs, width)
        assert all(sum(s["end"] - s["start"] for s in r["repeats"]) == r["n_removed"] for r in got)


def test_substring_table(spark, make_docs):
    docs = table(spark, "documents", "doc_id", "text")
    got = Q.op8_substring(spark, SF).collect()
    want = [(i, n, g, brute.sha(t)) for i, n, g, t in brute.remove_repeats(docs, 35)]
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert substring.remove_repeats(make_docs([])).count() == 0


@pytest.mark.parametrize("shingle,bits", [(4, 4), (2, 5), (1, 3)])
def test_simhash_equals_brute(spark, make_docs, shingle, bits):
    docs = odd_docs()
    df = make_docs(docs).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1)).repartition(3)
    got = simhash.near_duplicates(df, shingle=shingle, bits=bits).collect()
    assert sorted(tuple(map(str, r)) for r in got) == brute.near_duplicates(docs, shingle, bits)


def test_simhash_table(spark, make_docs):
    docs = table(spark, "documents", "doc_id", "text")
    got = Q.op9_simhash(spark, SF).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(tuple(map(str, r)) for r in got) == brute.near_duplicates(docs, 4, 4)
    assert simhash.near_duplicates(make_docs([])).count() == 0
    stay = {r["doc_id"] for r in simhash.one_of_each(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert stay == {int(c) for _, _, c in brute.near_duplicates(docs, 4, 4)}


def test_forest_connects_dense_crowds(spark):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for _ in range(1500)})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 4)
    comp = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    root = {i: i for i in range(len(fps))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, (s,) in enumerate(signed):
        groups.setdefault(find(i), set()).add(comp.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)
    assert edges.count() < 66 * len(fps)


def test_components_of_a_path(spark):
    rows = [(i + 1, i) for i in range(200)] + [(1000, 1001), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def contaminated_rows(df):
    r = decontaminate.flag(df).select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    return sorted((str(x[0]), *x[1:]) for x in r)


def test_decontaminate_equals_brute(spark, make_docs):
    docs = odd_docs()
    docs += [(200, "Und ÜBER-all; die Katze saß auf der Matte und SCHLIEF dort den ganzen Tag lang ohne Ende"), (201, "short, item"), (202, "short item")]
    items = [(1, "short item"), (1, "katze SASS"), (2, None), (3, "..."), (None, docs[20][1]), (7, docs[15][1]), (10, "x y"), (9, " ".join(docs[30][1].split()[:40])),
             (4, "die katze saß auf der matte und schlief dort den ganzen tag lang ohne")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = make_docs(docs).withColumn("N_HIT", F.lit(0)).withColumn("spans", F.lit("x")).repartition(2)
    want = brute.contamination(docs, items, 13)
    assert contaminated_rows(decontaminate.find_contamination(df, bench)) == want
    assert contaminated_rows(decontaminate.find_contamination(df, bench, block_bytes=300)) == want
    spans = {r["doc_id"]: r["spans"] for r in decontaminate.find_contamination(df, bench).collect()}
    assert [docs[-3][1][s["start"]:s["end"]] for s in spans[200]] == ["die Katze saß auf der Matte und SCHLIEF dort den ganzen Tag lang ohne"]
    assert contaminated_rows(decontaminate.find_contamination(df, bench.limit(0))) == brute.contamination(docs, [], 13)
    left = decontaminate.drop_contaminated(df, bench)
    assert left.columns == df.columns and left.count() == sum(not w[-1] for w in want)
    assert decontaminate.find_contamination(make_docs([]), bench).count() == 0


def test_decontaminate_table(spark):
    got = Q.op10_decontaminate(spark, SF).collect()
    want = brute.contamination(table(spark, "documents", "doc_id", "text"), table(spark, "benchmark", "item_id", "text"), 13)
    assert sorted((str(r[0]), *r[1:]) for r in got) == want


def test_contamination_by_blocks_equals_windows():
    """Aligned blocks and comparison around them against plain windows."""
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcd")
    for width in (2, 3, 13):
        items = [(str(i), " ".join(word() for _ in range(rnd.randrange(0, 4 * width))).encode()) for i in range(12)]
        scanner = decontaminate.Scanner(items, width)
        for _ in range(150):
            words = [word().encode() if rnd.random() < 0.95 else b"other" for _ in range(rnd.randrange(0, 60))]
            for _, t in rnd.sample(items, 2):
                k = rnd.randrange(0, len(words) + 1)
                w = t.split()
                words[k:k] = w[rnd.randrange(0, len(w) + 1):][:rnd.randrange(0, 3 * width)]
            hit, names = set(), set()
            for name, t in items:
                w = t.split()
                for q in range(max(1, len(w) - width + 1) if w else 0):
                    win = w[q:q + width]
                    for x in range(len(words) - len(win) + 1):
                        if words[x:x + len(win)] == win:
                            hit.update(range(x, x + len(win)))
                            names.add(name)
            flags, found = scanner.scan(words)
            assert found == names and hit == (set() if flags is None else set(np.flatnonzero(flags).tolist()))


def test_substring_of_rows_repeated_in_bulk(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(5000).selectExpr("cast(7 as long) doc_id", f"'{words}' text").union(
        spark.range(1500).selectExpr("cast(null as long) doc_id", "'few words' text")).union(
        spark.createDataFrame([(1, words + " tail " + "x " * 40), (2, " ".join(f"v{i}" for i in range(60)))], "doc_id long, text string"))
    for broadcast in (1_000_000, 0):
        monkeypatch.setattr(substring, "BROADCAST_ROWS", broadcast)
        got = {(r.doc_id, r.n_words, r.n_removed, r.kept_text[:8]): r["count"] for r in substring.remove_repeats(rows.repartition(4), width=35)
               .groupBy("doc_id", "n_words", "n_removed", "kept_text").count().collect()}
        assert got == {(7, 60, 60, ""): 5000, (None, 2, 0, "few word"): 1500, (1, 101, 100, "tail"): 1, (2, 60, 0, "v0 v1 v2"): 1}
    chunks, _, _ = substring.chunk_of(rows, "doc_id", "text")
    assert chunks.count() == 4
