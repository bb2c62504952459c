"""Toxicity, quotation linking, WARC and licence scans."""

import base64
import hashlib
import os
import random

import numpy as np
from pyspark.sql import functions as F

import brute
from abundance.llm import licenses, queries as Q, quotes, toxicity, warc
from test_text_ops import SF, table


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_ordinal_gradient_and_order():
    rnd = np.random.default_rng(0)
    dense = rnd.normal(size=(400, 6))
    true = np.array([2.0, -1.5, 0, 0, 1, 0])
    latent = dense @ true + rnd.logistic(size=400)
    grade = np.digitize(latent, [-1.0, 1.5])
    x = toxicity.Sparse([(np.arange(6), r) for r in dense])
    w, t = toxicity.fit_ordinal(x, grade, 6, penalty=0.0, rounds=1500)
    assert t[0] < t[1] and np.abs(w - true).max() < 0.6 and abs(t[0] + 1) < 0.6 and abs(t[1] - 1.5) < 0.6

    def loss(w, t):
        c = np.concatenate((np.zeros((400, 1)), 1 / (1 + np.exp(-(t[None, :] - (dense @ w)[:, None]))), np.ones((400, 1))), axis=1)
        return -np.log(np.take_along_axis(np.diff(c, axis=1), grade[:, None], 1)).mean()
    best = loss(w, t)
    for _ in range(40):  # a maximum of the likelihood
        assert loss(w + rnd.normal(scale=0.1, size=6), t + rnd.normal(scale=0.05, size=2)) > best - 1e-6


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(10))
    model = toxicity.fit(docs, labels.where(part < 6))
    rows = toxicity.score(docs.join(labels.where(part >= 6), "doc_id"), model).collect()
    y = np.array([r["toxic"] for r in rows])  # the label was replaced by the verdict
    truth = {r[0]: r[1] for r in labels.select("doc_id", "toxic").collect()}
    t = np.array([truth[r["doc_id"]] for r in rows])
    s = np.array([r["expected_severity"] for r in rows])
    assert auc(s, t) > 0.8 and (y == (t == 1)).mean() > 0.92 and not (y & (t == 0)).sum() > 3
    assert all(0 <= r["expected_severity"] <= 2 and r["severity"] in (0, 1, 2) for r in rows)


def test_toxicity_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (1, None), (2, ""), (None, "idiot"), (3, "word " * 50000)]).withColumn("SEVERITY", F.lit("x"))
    none = spark.createDataFrame([(1, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(rows) == 5 and all(r["expected_severity"] < 1e-9 and not r["toxic"] for r in rows)
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none.limit(0))).count() == 0


def test_toxicity_table_equals_plain_scores(spark):
    """The registered query against word counts and sums in plain Python."""
    import math
    import re

    import xxhash
    docs = table(spark, "documents", "doc_id", "text")
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    want = []
    for i, text in docs:
        counts = {}
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", brute.lower(text or "").encode()):
            for part in [w] + [b"^" + w[:k] for k in (4, 6) if len(w) > k]:
                c = xxhash.xxh64_intdigest(part, 7) % len(model.weights)
                counts[c] = counts.get(c, 0) + 1
        value = {c: math.log(1 + n) * model.scales[c] for c, n in counts.items()}
        length = math.sqrt(sum(v * v for v in value.values())) or 1.0
        s = sum(v / length * model.weights[c] for c, v in value.items())
        at_most = [1 / (1 + math.exp(-(t - s))) for t in model.thresholds]
        p = [at_most[0], *(b - a for a, b in zip(at_most, at_most[1:])), 1 - at_most[-1]]
        want.append((i, sum(1 - a for a in at_most), p.index(max(p)), at_most[0] < 0.5))
    got = sorted(tuple(r) for r in Q.op1_toxicity(spark, SF).collect())
    assert [g[0] for g in got] == [w[0] for w in sorted(want)] and any(w[3] for w in want)
    for g, w in zip(got, sorted(want)):
        assert abs(g[1] - w[1]) < 1e-4 and (g[2:] == w[2:] or min(abs(w[1] - k) for k in (0.5, 1.0, 1.5)) < 1e-2)


def test_toxicity_sample_is_bounded(spark, make_docs):
    rows = [(i, f"idiot moron w{i}" if i % 2 else f"nice words v{i}") for i in range(40)]
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)] * 3, "doc_id long, quality int, toxic int")
    once, often = toxicity.fit(make_docs(rows), labels), toxicity.fit(make_docs(rows * 5), labels)
    assert np.array_equal(once.weights, often.weights) and np.array_equal(once.thresholds, often.thresholds)
    few = toxicity.fit(make_docs(rows), labels, max_bytes=300)
    assert not np.array_equal(few.weights, once.weights)


MAIL = [
    (1, 0, "Hello  all\nsecond LINE"), (1, 1, "On Monday A wrote:\n> hello all\n>  Second line\nfine"), (1, 2, "> > Hello all\n> fine\n\nthanks"),
    (1, 3, "x wrote:\nno quote here\n> hello all\n>fine\n> unknown words"), (1, 4, ">>> deep\n>> Fine"), (1, 4, ">>> deep\n>> Fine"), (2, 5, "> Hello all"), (2, 1, "> thanks\n"),
    (None, 0, "> fine"), (3, None, "> a b"), (3, 1, None), (3, 2, ""), (3, 3, "a b"), (3, 4, "> a b\r\n> a b\nok"), (3, 9, "a b\n> later\n"), (3, 10, "later"), (3, 11, "> a b\n> later")]


def test_quotes_equal_brute(spark):
    chain = [(7, i, f"> word{i - 1} said\nword{i} said") for i in range(40)]
    rows = MAIL + chain + [(8, i, "same old\n> same old") for i in range(300)]
    df = spark.createDataFrame([(c, t, "user", x, 1) for c, t, x in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = quotes.conversations(df).collect()
    assert sorted((str(r["conv_id"]), str(r["turn"]), str(r["reply_to"]), str(r["root"]), r["depth"], r["n_quotes"], r["text"]) for r in got) == brute.conversations(rows)
    assert quotes.conversations(df.limit(0)).count() == 0


def test_quotes_of_repeated_and_short_messages(spark):
    rows = [(1, 0, "yes"), (1, 1, "Which one?"), (1, 2, "yes"), (1, 3, "> yes\ndone"), (2, 0, "B"), (2, 1, "> B\nright"),
            (3, 0, "first line\nsecond line\n\nthird"), (3, 1, "second line"), (3, 2, "> first line\n> second line\nto both"), (3, 3, "> second line\n> unknown\nx"),
            (4, 0, "a b\n\nc"), (4, 1, "c\n\na b"), (4, 2, "> a b\n>\n> c\nwhole"), (4, 3, "> c\n>\n> a b")]
    got = {(r.conv_id, r.turn): r.reply_to for r in quotes.conversations(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, 3] == 2 and got[2, 1] == 0 and got[3, 2] == 0 and got[3, 3] == 1 and got[4, 2] == 0 and got[4, 3] == 1


def test_quotes_table(spark):
    turns = {(c, t): x for c, t, x in table(spark, "conversations", "conv_id", "turn", "text")}
    rows = []
    for (c, t), x in turns.items():
        parts = ["> " * k + turns[c, t - k].replace("\n", "\n" + "> " * k) for k in (2, 1) if (c, t - k) in turns]
        rows.append((c, t, "\n".join([*parts, x])))
    want = [(c, t, r, o, d, n, brute.sha(x)) for c, t, r, o, d, n, x in brute.conversations(rows)]
    got = Q.op4_quotes(spark, SF).collect()
    assert sorted((str(r["conv_id"]), str(r["turn"]), str(r["reply_to"]), str(r["root"]), r["depth"], r["n_quotes"], r["text_sha256"]) for r in got) == want
    assert {x.strip("\n") for x in turns.values()} >= {r["text"] for r in quotes.conversations(quotes.quoted_mail(spark.read.parquet(f"{SF}/conversations.parquet"))).collect()}


def plain_pages(rows, min_bytes):
    first = {}
    for i, _, h in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= min_bytes:
            first[p] = min(first.get(p, i), i)
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        f = first.get(p)
        r = f if f is not None and f != i else None
        out.append((str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if r is None else "revisit", str(r)))
    return sorted(out)


PAGES = [(5, "http://a/\n b", "same"), (3, None, "same"), (9, "u", None), (8, "u", ""), (None, "u", "same"), (3, "twice", "same"), (11, "é", "WARC/1.1\r\n\x00é" * 50),
         (12, "big", "".join(random.Random(1).choices("abcdefgh\n", k=400_000)))]


def read_rows(df):
    h = F.col("headers")
    return sorted((str(r[0]), int(r[1]), r[2][5:], r[3], str(r[4])) for r in df.where("kind = 'record'").select(
        h["x-page-id"], h["x-payload-length"], h["warc-payload-digest"], h["warc-type"], h["x-refers-to-page"]).collect())


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1) for r in PAGES], "page_id long, url string, html string, payload int").repartition(2)
    for k in (0, 3, 5):
        warc.write_archives(df, str(tmp_path / str(k)), min_bytes=k)
        read = warc.read_archives(spark, str(tmp_path / str(k)))
        assert read_rows(read) == plain_pages(PAGES, k) and read.where("kind = 'gap'").count() == 0
    payloads = {r["headers"].get("x-page-id"): bytes(r["payload"]) for r in read.collect() if r["headers"]["warc-type"] == "response"}
    assert payloads["12"].decode() == PAGES[-1][2] and payloads["11"].decode() == PAGES[-2][2]
    warc.write_archives(df.limit(0), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_warc_table(spark):
    got = Q.op5_warc(spark, SF).collect()
    assert sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in got) == plain_pages(table(spark, "pages", "page_id", "url", "html"), 0)


def test_members_of_16_mib_end_in_zero():
    m = warc.gzip_member(b"x" * (1 << 24))
    assert m[-1] != 0 and (m + warc.gzip_member(b""))[-1] == 0
    found = list(warc.salvage(warc.gzip_member(warc.record_bytes(1, "u", os.urandom(100) * 200_000, None, "d")) + warc.gzip_member(b"")))
    assert [f[0] for f in found] == ["record"] and len(found[0][4]) == 20_000_000


def test_salvage_recovers_and_logs_gaps():
    rnd = random.Random(7)
    records = [warc.record_bytes(i, f"http://x/{i}", rnd.randbytes(rnd.randint(0, 3000)), 1 if i % 4 == 3 else None, "2000-01-01T00:00:00Z") for i in range(30)]
    for pack in (warc.gzip_member, lambda r: r):
        parts = [pack(r) for r in records]
        places = np.cumsum([0] + [len(p) for p in parts]).tolist()
        data = bytearray(b"".join(parts))
        hurt = {4, 5, 12, 29}
        for k in hurt:  # damage in the middle of four members, two of them neighbours
            mid = (places[k] + places[k + 1]) // 2
            for j in range(places[k] + 12, min(mid + 40, places[k + 1])):
                data[j] ^= 0x5A
        data = b"junk" + bytes(data[:places[20]]) + b"\x1f\x8b\x08 no member WARC/1.0\r\nno record" + bytes(data[places[20]:-3])
        found = list(warc.salvage(data))
        ids = [f[3]["x-page-id"] for f in found if f[0] == "record"]
        assert ids == [str(i) for i in range(30) if i not in hurt]
        assert sum(f[2] for f in found) == len(data) and [f[1] for f in found] == np.cumsum([0] + [f[2] for f in found])[:-1].tolist()
        gaps = [(f[1], f[2]) for f in found if f[0] == "gap"]
        assert len(gaps) == 5 and gaps[0] == (0, 4) and gaps[1] == (4 + places[4], places[6] - places[4])
    assert list(warc.salvage(b"")) == [] and [f[:3] for f in warc.salvage(b"nothing")] == [("gap", 0, 7)]


def test_salvage_inside_members():
    records = [warc.record_bytes(i, f"http://x/{i}", random.Random(i).randbytes(200), None, "d") for i in range(4)]
    ids = lambda found: [f[3]["x-page-id"] for f in found if f[0] == "record"]
    # Several records in one member, one of them damaged before compression.
    hurt = bytearray(records[1])
    hurt[-50] ^= 1
    data = warc.gzip_member(b"".join(records))
    found = list(warc.salvage(data))
    assert ids(found) == ["0", "1", "2", "3"] and sum(f[2] for f in found) == len(data) and found[1][5:] == (len(records[0]), len(records[1]))
    found = list(warc.salvage(warc.gzip_member(records[0] + bytes(hurt) + records[2])))
    assert ids(found) == ["0", "2"] and [f[5:] for f in found if f[0] == "gap"] == [(len(records[0]), len(hurt))]
    # A member that breaks off, and one with a wrong byte near its end.
    for short, n in ((8, 4), (10, 3), (60, 3)):
        cut = data[:-short]
        found = list(warc.salvage(cut + warc.gzip_member(records[3])))
        assert ids(found)[:n] == ["0", "1", "2", "3"][:n] and ids(found)[-1] == "3" and [f[1:3] for f in found if f[0] == "gap"] == [(0, len(cut))]
        assert ids(warc.salvage(cut))[:n] == ["0", "1", "2", "3"][:n]
    broken = bytearray(data)
    broken[len(data) * 3 // 4] ^= 0x55
    assert ids(warc.salvage(bytes(broken)))[:2] == ["0", "1"] and sum(f[2] for f in warc.salvage(bytes(broken))) == len(data)
    # Digests in lower case and hexadecimal, folded headers.
    r = records[2]
    digest = warc.payload_digest(random.Random(2).randbytes(200)).encode()
    for other in (digest.lower(), hashlib.sha1(random.Random(2).randbytes(200)).hexdigest().encode()):
        assert ids(warc.salvage(r.replace(digest, other))) == ["2"]
    assert [f[0] for f in warc.salvage(r.replace(digest, b"A" * 32))] == ["gap"]
    folded = list(warc.salvage(r.replace(b"X-Page-Id: 2", b"X-Page-Id:\r\n 2\r\nX-Note: a\r\n\tb")))
    assert ids(folded) == ["2"] and folded[0][3]["x-note"] == "a b"


def test_archive_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE", 4000)
    rnd = random.Random(3)
    rows = [(i, "u", rnd.randbytes(rnd.choice([10, 500, 3000, 20_000])).hex()) for i in range(200)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "a"))
    sizes = [f.stat().st_size for f in (tmp_path / "a").glob("part-*")]
    assert len(sizes) > 10 and max(sizes) < warc.BUNDLES * 4000 + 45_000
    assert read_rows(warc.read_archives(spark, str(tmp_path / "a"))) == plain_pages(rows, 0)


def test_licenses_equal_brute(spark, make_docs):
    t = licenses.TEMPLATES
    mit = t["MIT-text"].replace(". ", ".\n").replace(", ", ",\n")
    docs = [(1, None), (1, None), (2, ""), (3, "intro line\nReleased under the MIT license!\nmore"), (4, "/* " + mit + " */"), (5, "code code\n\n \n" + mit + "\n\nreal text here and more\n" * 30),
            (6, "This work is licensed under the GNU General Public License, version 2 or 3."), (7, "words " * 30000), (None, "Licensed under\fCC BY NC 4.0"),
            (8, "\n\n".join(t.values())), (9, "This work is licensed under a Creative Commons Attribution 4.0 licence\n\nx")] + table(spark, "documents", "doc_id", "text")
    df = make_docs(docs).withColumn("License", F.lit(1)).repartition(3)
    got = licenses.scan(df).collect()
    show = lambda i, hits: (str(i), sorted(hits))
    assert sorted(show(r["doc_id"], [(round(h["score"], 9), h["license"], licenses.UNITS.index(h["unit"]), h["piece"]) for h in r["licenses"]]) for r in got) == sorted(
        show(i, brute.licence_hits(x, t, 0.8)) for i, x in docs)
    for r in got:
        best = min(((-h["score"], h["license"]) for h in r["licenses"]), default=(None, None))
        assert r["license"] == best[1] and (r["license_score"] is None) == (best[0] is None)
    assert licenses.scan(make_docs([])).count() == 0
    assert sum(r["license"] is not None for r in Q.op6_licenses(spark, SF).collect()) > 0
