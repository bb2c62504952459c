"""Quality rules and PII against plain versions; the pipeline as a whole."""

import random

from pyspark.sql import functions as F

import brute
import corpus_pipeline
from abundance.llm import pii, quality, queries as Q
from test_text_ops import SF, odd_docs, table


def test_quality_counts_equal_brute(spark, make_docs):
    docs = odd_docs() + [(300, "a b c a b c a b c"), (301, "x\nx\n\n y\n y\nx"), (302, "# * $ % & | < >    éé"), (303, "w " * 3000),
                         (304, "\n".join(["same line here"] * 50)), (305, "a b c d a b c e b c d")]
    df = make_docs(docs).withColumn("N_Words", F.lit("clash")).withColumn("kept", F.lit(0))
    got = sorted((str(r["doc_id"]), *[r[c] for c in quality.COUNTS]) for r in quality.add_counts(df).collect())
    assert got == sorted((str(i), *brute.quality_counts(t).values()) for i, t in docs)
    assert quality.keep_good(df).columns == df.columns
    assert quality.score(make_docs([])).count() == 0


def plain_verdict(docs):
    votes = []
    for _, t in docs:
        c = brute.quality_counts(t)
        vote = lambda r: -1 if eval(r.poor, {}, c) else 1 if eval(r.good, {"false": False}, c) else 0  # noqa: E731, B023
        votes.append(tuple(vote(r) for r in quality.RULES))
    counts = {}
    for v in votes:
        counts[v] = counts.get(v, 0) + 1
    prior, accuracy = quality.fit(sorted(counts.items()))
    out = {}
    for (i, t), v in zip(docs, votes):
        c = brute.quality_counts(t)
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        out[i] = (failed, not failed and quality.probability(v, prior, accuracy) >= 0.5)
    return out


def test_quality_table_and_labels(spark):
    docs = table(spark, "documents", "doc_id", "text")
    want = plain_verdict(docs)
    rows = Q.op3_quality(spark, SF).collect()
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in rows} == want
    label = dict(table(spark, "labels", "doc_id", "quality"))
    kept = {r["doc_id"]: r["kept"] for r in rows if not r["base_failed"] and r["doc_id"] in label}
    good = [k for i, k in kept.items() if label[i] == 1]
    poor = [k for i, k in kept.items() if label[i] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(poor) <= 0.4 * max(1, len(poor))


def test_em_recovers_accuracies():
    rnd = random.Random(4)
    true, prior = [0.9, 0.75, 0.65, 0.85], 0.8
    counts = {}
    for _ in range(40000):
        y = 1 if rnd.random() < prior else -1
        v = tuple(0 if rnd.random() < 0.2 else y if rnd.random() < a else -y for a in true)
        counts[v] = counts.get(v, 0) + 1
    p, a = quality.fit(sorted(counts.items()), rounds=500)
    assert abs(p - prior) < 0.05 and all(abs(x - y) < 0.05 for x, y in zip(a, true))


PII_DOCS = [
    (1, "mail a.b+c@x-y.example.com, a@b.c@d.e and a@b.cd+x@e.f.; none@host x@.y"), (2, None), (2, ""), (None, "+1 (499) 555-6503 +12 +1--2 +123456789012345678"),
    (3, "ip 1.2.3.4.5.6.7.8 256.1.1.1 000255.0.0.00 1.2.3 99999999999999999999.1.1.1"), (4, "4111 1111 1111 1111 and 4111-1111-1111-1112 é 5500000000000004 12345678901234567890123"),
    (5, "é😀 kontakt: ü@ö.de x@y.zz\n" + "9" * 30000 + " " + "a" * 30000 + "@" + "1.1" * 2000), (6, "x" * 20000 + " q@r.st")]


def disclosing_docs():
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "und", "the"]
    docs = [(100 + i, " ".join(rnd.choices(words, k=12)) + "\n" + " ".join(rnd.choices(words, k=5))) for i in range(60)]
    docs += [(200 + i, f"{rnd.choice(words)} Zebulon wrote {i} times from z.q@mail.example.org {rnd.choice(words)}\nZebulon, 7731x") for i in range(12)]
    docs += [(300 + i, "copied Quirk line k.v@mail.example.org same") for i in range(6)]
    docs += [(400, "only Zebulon here; Zebulons not. 7731x")]
    return docs


def spans_of(df):
    return sorted((str(r["doc_id"]), [tuple(s) for s in r["spans"]]) for r in df.collect())


def test_pii_equals_brute(spark, make_docs, monkeypatch):
    docs = PII_DOCS + disclosing_docs()
    terms = brute.disclosing_terms([t for _, t in docs], pii.ALPHA, pii.SUPPORT)
    assert "Zebulon" in terms and "Quirk" not in terms and "the" not in terms
    df = make_docs(docs).withColumn("spans", F.lit("clash")).withColumn("TERM", F.lit(1)).repartition(3)
    want = sorted((str(i), brute.all_spans(t, terms)) for i, t in docs)
    assert spans_of(pii.find(df)) == want
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert spans_of(pii.find(df)) == want
    clean = pii.sanitise(make_docs(docs))
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in clean.collect()) == sorted(
        (str(i), brute.redact(t or "", brute.all_spans(t, terms))) for i, t in docs)
    assert pii.find(make_docs([])).count() == 0 and pii.sanitise(make_docs([])).count() == 0


def test_pii_table(spark):
    docs = table(spark, "documents", "doc_id", "text")
    terms = brute.disclosing_terms([t for _, t in docs], pii.ALPHA, pii.SUPPORT)
    rows = {r["doc_id"]: r for r in Q.op2_pii(spark, SF).collect()}
    for i, t in docs:
        spans = brute.all_spans(t, terms)
        text = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b, _ in spans]
        assert rows[i]["spans"] == ",".join(text)
        assert rows[i]["base_sha256"] == brute.sha(",".join(x for x in text if not x.startswith("term")))
        assert [rows[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == j for s in spans) for j in range(5)]


def test_pipeline_equals_brute(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_file("byte_bpe_50k.json"))
    docs = table(spark, "documents", "doc_id", "text")
    verdict = plain_verdict(docs)
    docs = [d for d in docs if verdict[d[0]][1]]
    docs = [(i, t) for i, t in docs if str(i) in {c for _, _, c in brute.near_duplicates(docs, 4, 4)}]
    bad = {r[0] for r in brute.contamination(docs, table(spark, "benchmark", "item_id", "text"), 13) if r[-1]}
    docs = [d for d in docs if str(d[0]) not in bad]
    terms = brute.disclosing_terms([t for _, t in docs], pii.ALPHA, pii.SUPPORT)
    docs = [(i, brute.redact(t, brute.all_spans(t, terms))) for i, t in docs]
    want = sorted((i, len(tok.encode(t, add_special_tokens=False).ids), brute.sha(t)) for i, t in docs)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in got) == want


def test_pipeline_on_empty_and_odd_documents(spark, make_docs, tmp_path):
    for k, rows in enumerate([[], odd_docs() + PII_DOCS]):
        d = str(tmp_path / str(k))
        make_docs(rows).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, "some item")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        assert corpus_pipeline.run(spark, d).count() <= len(rows)
