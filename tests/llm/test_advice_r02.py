"""Cases of the second review: rare entities, overlapping spans, licence layouts."""

import random

from abundance.llm import licenses, pii


def filler(n, seed):
    rnd = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "und", "the", "pier", "boat", "reef", "sand"]
    return [(1000 + i, " ".join(rnd.choices(words, k=9))) for i in range(n)]


def terms_of(spark, docs):
    return {r["term"] for r in pii.disclosing_terms(spark.createDataFrame([(t,) for _, t in docs], "text string")).collect()}


def test_rare_entities_are_judged(spark):
    base = filler(400, 1)
    # An entity on two lines of two documents.
    twice = [(1, "the Marlowe sand pier q.one@first.example"), (2, "boat Marlowe q.one@first.example und reef")]
    assert terms_of(spark, base + twice) == {"Marlowe"}
    # Each address and phone once; their mail domain and prefix hold the evidence.
    pool = [(i, f"Ostrava boat p{'abcd'[i]}@second.example reef") for i in range(4)]
    pool += [(i, f"Pemba sand +4930555{i}81{i} the reef") for i in range(4)]
    assert terms_of(spark, base + pool) == {"Ostrava", "Pemba"}
    more = [(500 + i, t + f" x{i}@d{i}.example") for i, (_, t) in enumerate(filler(12, 2))]
    # One line, however often copied, and two lines of one document are one observation.
    assert terms_of(spark, base + more + [(i, "Quirk boat k.v@third.example") for i in range(9)]) == set()
    assert terms_of(spark, base + more + [(1, "Quirk boat k.v@third.example\nQuirk reef k.v@third.example")]) == set()
    # A single line suffices where the corpus is large next to its pairs.
    assert terms_of(spark, base + [(1, "Sibyl boat s@fourth.example")]) == {"Sibyl"}


def test_overlapping_spans_leave_no_tail(make_docs):
    docs = [("Tel +49 30 1234567info@firma-mail.de", "Tel [PHONE]"), ("a@b.4111 1111 1111 1111", "[EMAIL]"),
            ("4111 1111 1111 1111@x.com", "[CARD]"), ("x +49 30 1234567info@firma-mail.de, a@b.cd y", "x [PHONE], [EMAIL] y"),
            ("é a@b.4111 1111 1111 1111@x.com z", "é [EMAIL] z"), ("+49 30 1234567", "[PHONE]")]
    got = pii.sanitise(make_docs([(i, t) for i, (t, _) in enumerate(docs)])).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {i: want for i, (_, want) in enumerate(docs)}


def test_licence_passages(make_docs):
    t = licenses.TEMPLATES
    gpl = t["GPL-3.0-header"]
    cut, cut2 = gpl.index("This program is distributed"), gpl.index("See the GNU")
    split = f"{gpl[:cut]}\n\n{gpl[cut:cut2]}\n\n{gpl[cut2:]}"
    disclaimer = (
        " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED "
        "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
        "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED")
    wrapped = t["ISC"].replace(" is hereby", "\nis hereby")
    docs = [(split + "\n\n" + " ".join(f"w{i}" for i in range(90)), [("GPL-3.0-header", "passage", 0)]),
            (t["BSD-2-Clause"] + disclaimer, [("BSD-2-Clause", "passage", 0)]),
            ("Some words about it. Released under the MIT License. More words follow here", [("MIT", "passage", 0)]),
            ("a b c " + wrapped + " d e f g\nh i j. Some text, released under the MIT License, and so on and on.\nLicensed under CC BY-NC 4.0.",
             [("CC-BY-NC-4.0", "line", 3), ("ISC", "passage", 0), ("MIT", "passage", 1)]),
            ("x released under\nan MIT licence", []), ("released under the\nLicensed under CC BY-NC 4.0.\nMIT License", [("CC-BY-NC-4.0", "line", 1)]),
            ("plain words " * 400, [])]
    got = licenses.scan(make_docs([(i, x) for i, (x, _) in enumerate(docs)])).collect()
    assert {r["doc_id"]: [(h["license"], h["unit"], h["piece"]) for h in r["licenses"]] for r in got} == {i: w for i, (_, w) in enumerate(docs)}
