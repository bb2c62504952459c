r"""PII spans and information-theoretic sanitisation (operator 2), DataFrame
functions only.

Base spans come from four patterns (email, ip, card, phone), leftmost and
non-overlapping per kind; matches that fail their check (address parts, digits,
Luhn) are dropped and not retried.

Method (after Sanchez and Batet, "C-sanitized", 2016): every base value is a
protected entity, however rare, and so is the pool it belongs to (mail domain,
/24 network, first six digits of a card, first five of a phone). A term t on
the lines that hold an entity or pool e discloses it if the pointwise mutual
information reaches 1/alpha of the entity's information,

    pmi = log2(N n_te / (n_t n_e)) >= -log2(n_e / N) / alpha,

where N, n_t, n_e and n_te are the documents of the whole corpus, those with
the term, those with the entity, and those with the term on a line of the
entity. With alpha near 1 this asks that the term (almost) determines the
entity. As small counts reach this by chance, the pair's evidence also has to
outweigh the number of pairs judged,

    k pmi >= log2(pairs) + support   (bits),

where k is the smaller of the different lines and the different documents of
the pair, so that copies of a line or a text count once. No count is asked
for: a pair seen on two lines discloses if it is surprising enough, and one
seen on a single line if the corpus is large next to its pairs. Wherever a
disclosing term occurs, it gets a span of kind ``term``; ``sanitise`` replaces
spans by their class ([EMAIL], ..., and a term by [WORD] or [NUMBER]).

Scale. Patterns run where the text is. Pairs are made on the lines that hold an
entity; term counts are combined before their shuffle, and entity counts
likewise. Words are counted over the corpus for those pairs only whose evidence
could suffice if their term occurred nowhere else. The disclosing terms are broadcast only
if there are at most ``BROADCAST_TERMS`` of them (they are counted first);
otherwise documents' terms meet them in a shuffled join. Texts are shuffled
only if some term discloses, and then copies of a frequent text are dealt out
(``joins.spread_join``).

Defined cases: null and empty texts have no spans. Repeated rows are counted
and treated like other rows. Null ids are kept; only the id and text columns
are read by ``find``, so other columns cannot clash; ``sanitise`` returns the
input's columns. An empty table gives an empty table. Patterns are written
with possessive repetition and start either after a non-member of their first
class or where the last match ended, which finds the same matches as plain
repetition in time linear in the text, however long a run of letters or digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from abundance.operators.joins import spread_join
from abundance.session import cut_lineage

# The base patterns of the four kinds, in their order.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without a match of its kind's gate has no valid match.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"[\p{L}\p{N}]+"
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
ALPHA, SUPPORT, BROADCAST_TERMS = 1.05, 3, 100_000


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """14 to 19 digits whose Luhn sum is a multiple of ten."""
    d = F.reverse(digits(m))
    weights = F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: (
        F.substring(d, i + 1, F.lit(1)).cast("int") * (i % 2 + 1)))
    total = F.aggregate(weights, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return F.when(F.length(d).between(14, 19), total % 10 == 0).otherwise(False)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
    "card": luhn,
    "phone": lambda m: F.length(digits(m)).between(10, 15),
}


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """All matches as array<struct<start,kind,end,value>>: the text between
    matches and the matches give the offsets, in code points."""
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    state = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(a, p):
        start = a["at"] + F.length(p["gap"])
        end = start + F.length(p["value"])
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(a["spans"], F.array(one)).alias("spans"))

    return F.aggregate(pairs, state, step)["spans"]


def valid(found: Column, check) -> Column:
    return F.filter(found, lambda m: check(m["value"]))


def base_spans(text: Column) -> Column:
    """The valid base matches of all kinds, by start and then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    parts = []
    for k, kind in enumerate(PATTERNS):
        found = valid(matches(text, F.lit(PATTERNS[kind]), k), CHECKS[kind])
        parts.append(F.when(text.rlike(GATES[kind]), found).otherwise(none))
    return F.sort_array(F.concat(*parts))


def entities(spans: Column) -> Column:
    """Hashes of the spans' values and of the pools that the values belong to."""
    def keys(s):
        v, d = F.lower(s["value"]), digits(s["value"])
        value = F.when(s["kind"] < 2, v).otherwise(d)
        pool = F.when(s["kind"] == 0, F.substring_index(v, "@", -1)).when(s["kind"] == 1, F.substring_index(v, ".", 3)).when(
            s["kind"] == 2, F.substring(d, 1, 6)).otherwise(F.substring(d, 1, 5))
        return F.array(F.xxhash64(s["kind"], F.lit("value"), value), F.xxhash64(s["kind"], F.lit("pool"), pool))

    return F.array_distinct(F.flatten(F.transform(spans, keys)))


def disclosing_terms(docs: DataFrame, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """(term): the terms that disclose some entity of the corpus; docs has
    ``text``."""
    n_docs = docs.count()
    lined = docs.where(F.col("text").rlike("|".join(f"(?:{p})" for p in PATTERNS.values()))).select(
        F.xxhash64("text").alias("doc"), F.explode(F.split("text", "\n", -1)).alias("line"))
    held = lined.withColumn("spans", base_spans(F.col("line"))).where(F.size("spans") > 0)
    bare = F.col("line")
    for p in PATTERNS.values():
        bare = F.regexp_replace(bare, p, " ")
    held = cut_lineage(held.select("doc", F.xxhash64("line").alias("line"), entities(F.col("spans")).alias("entities"),
                                   F.array_distinct(F.regexp_extract_all(bare, F.lit(TERM), F.lit(0))).alias("terms")).dropDuplicates(["doc", "line"]))
    # Documents of an entity: rows, not different texts, so that n_e, n_te and n_t count alike.
    copies = docs.groupBy(F.xxhash64("text").alias("doc")).agg(F.count("*").alias("copies"))
    near = held.select("doc", "line", "terms", F.explode("entities").alias("e")).join(copies, "doc")
    n_e = near.select("e", "doc", "copies").distinct().groupBy("e").agg(F.sum("copies").alias("n_e"))
    pairs = near.select("e", "doc", "line", "copies", F.explode("terms").alias("term"))
    per_doc = pairs.groupBy("e", "term", "doc").agg(F.first("copies").alias("copies"))
    n_te = per_doc.groupBy("e", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("texts"))
    lines = pairs.select("e", "term", "line").distinct().groupBy("e", "term").agg(F.count("*").alias("lines"))
    judged = cut_lineage(lines.join(n_te, ["e", "term"]).select("e", "term", "n_te", F.least("lines", "texts").alias("k")))
    n_pairs = judged.count()
    if not n_pairs:
        return judged.select("term")
    n, bits = F.lit(float(n_docs)), F.lit(math.log2(n_pairs) + support - 1e-9)
    # A term occurs in n_te documents at least, so its pmi is at most log2(n / n_e).
    candidates = cut_lineage(judged.join(n_e, "e").where((F.col("n_e") < n) & (F.col("k") * F.log2(n / F.col("n_e")) >= bits)))
    if candidates.isEmpty():
        return candidates.select("term")
    n_t = docs.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("term")).groupBy("term").agg(
        F.count("*").alias("n_t"))
    pmi = F.log2(n * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    return candidates.join(n_t, "term").where((pmi >= -F.log2(F.col("n_e") / n) / F.lit(alpha) - 1e-9) & (F.col("k") * pmi >= bits)).select("term").distinct()


def term_pattern(terms: Column) -> Column:
    """Whole words that are one of the terms (letters and digits only)."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(terms, "|"), F.lit(r")(?![\p{L}\p{N}])"))


def with_spans(docs: DataFrame, terms: DataFrame | None = None, alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """docs (with ``text``) and column ``spans``: array<struct<start,kind,end,
    value>>, base and term spans by start and kind; kind is the place in KINDS."""
    whole = docs.withColumn("text", F.coalesce("text", F.lit("")))
    if terms is None:
        terms = disclosing_terms(whole.select("text"), alpha, support)
    terms = cut_lineage(terms)
    n = terms.count()
    if not n:
        return docs.withColumn("spans", base_spans(F.coalesce("text", F.lit(""))))
    side = F.broadcast(terms) if n <= BROADCAST_TERMS else terms
    has = whole.select(F.xxhash64("text").alias("__key"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)))).alias("term"))
    of_doc = has.distinct().join(side, "term", "left_semi") if n > BROADCAST_TERMS else has.join(side, "term", "left_semi").distinct()
    of_doc = of_doc.groupBy("__key").agg(F.sort_array(F.collect_list("term")).alias("__terms"))
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce("text", F.lit(""))))
    counts = cut_lineage(keyed.groupBy("__key").agg(F.count("*").alias("__n")))
    d = spread_join(keyed, of_doc, "__key", "left", counts=counts).drop("__key")
    text = F.coalesce("text", F.lit(""))
    d = d.withColumn("__base", base_spans(text))
    extra = F.filter(matches(text, term_pattern(F.col("__terms")), 4), lambda t: ~F.exists(
        "__base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    return d.withColumn("spans", F.sort_array(F.when(F.col("__terms").isNull(), F.col("__base")).otherwise(F.concat("__base", extra)))).drop("__base", "__terms")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """One row per document: doc_id and spans, as ``with_spans``."""
    src = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return with_spans(src, None, alpha, support).drop("text")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its class; spans that overlap are
    replaced as one, by the class of the one that starts first (then the first
    kind)."""
    label = lambda s: F.element_at(F.array(*[F.lit(x) for x in LABELS.values()], F.when(s["value"].rlike(r"^\p{N}+$"), "[NUMBER]").otherwise("[WORD]")), s["kind"] + 1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a, s):
        gap = F.substring(text, a["at"] + 1, s["start"] - a["at"])
        wider = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts"))
        return F.when(s["start"] < a["at"], wider).otherwise(F.struct(s["end"].alias("at"), F.concat(a["parts"], F.array(gap, label(s))).alias("parts")))

    done = F.aggregate(spans, state, step)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, text: str = "text", alpha: float = ALPHA, support: int = SUPPORT) -> DataFrame:
    """The same rows and columns with the text's spans replaced by their class."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    held = with_spans(docs.select(F.struct(F.lit(0).alias("__"), *rest).alias("row"), F.col(f"`{text}`").alias("text")), None, alpha, support)
    return held.select(*[redact(F.col("text"), F.col("spans")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
