r"""Quality rules by weak supervision (operator 3), DataFrame functions only.

Rules look at a document's counts and vote good (1), poor (-1) or abstain (0).
Instead of requiring that all rules pass, a latent-class model with one
accuracy per rule is fitted by expectation-maximisation to the votes of the
whole corpus, without labels, and a document is kept if its posterior
probability of good quality is at least ``threshold`` (and it does not fail
the two base checks).

Model: a document is good with probability ``prior``; a rule that votes is
right with probability ``accuracy[rule]``, independently of the other rules;
abstaining says nothing. A document's evidence is its vote pattern, so the
corpus enters the fit as counts of patterns: one aggregate of at most 3^rules
rows (a bound that does not depend on the data), combined before its shuffle.
EM over these counts takes milliseconds on the driver; the posterior is then a
plain column expression over the votes. Accuracies are kept within [0.55,
0.99], so that a rule means what it says and the two classes cannot swap.

Counts are made row by row without a shuffle; texts never leave their task.
Three-word windows are compared by their 64-bit hashes within a document, and
only documents in which a hash repeats take the sort that finds where.

Defined cases: null text counts as a text without words. Documents without
words fail the base check. A rule whose ratio has no denominator abstains. If
no rule votes, the posterior is the prior. Rows are judged one by one, so
repeated rows agree. Input columns named like an output are replaced (any
case). An empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from abundance.llm.common import SPACE_CLASS, drop_clashes
from abundance.session import cut_lineage

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """A vote: poor where ``poor`` holds, else good where ``good`` holds, else
    none. Both are SQL conditions over the counts."""
    name: str
    good: str
    poor: str

    def vote(self) -> Column:
        return F.expr(f"case when {self.poor} then -1 when {self.good} then 1 else 0 end")


# Ratios of symbols and of repetition vote both ways. A usual length, word
# length or line length is no sign of quality, so those rules only vote poor.
RULES = (
    Rule("symbols_per_word", "50 * n_symbols <= n_words and n_words > 0", "5 * n_symbols > n_words"),
    Rule("symbols_per_character", "200 * n_symbols <= word_chars and n_words > 0", "20 * n_symbols > word_chars"),
    Rule("repeated_words", "20 * n_repeat_words <= n_words and n_words > 0", "5 * n_repeat_words > 2 * n_words"),
    Rule("duplicate_lines", "false", "10 * n_dup_lines > 3 * n_lines"),
    Rule("length", "false", "n_words < 50"),
    Rule("word_length", "false", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("line_length", "false", "n_words < 2 * n_lines"),
)


def add_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base counts of the text (``COUNTS``, long)."""
    own = [c for c in docs.columns if c.lower() not in COUNTS]
    keep = [f"`{c}`" for c in own]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    low = SPACE_CLASS[1:-1]
    d = docs.select(*keep, body.alias("__t"))
    d = d.select(*keep, "__t", F.array_remove(F.split("__t", SPACE_CLASS + "+", -1), "").alias("__w"),
                 F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(f"[^{low}]")).alias("__l"))
    words, n = F.col("__w"), F.size("__w")
    d = d.select(*keep, "__t", "__w", "__l", F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).alias("__h"))
    return d.select(*keep, n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
                    F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                    F.size("__l").cast("long").alias("n_lines"),
                    (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
                    repeat_words(F.col("__h")).cast("long").alias("n_repeat_words"))


def repeat_words(h: Column) -> Column:
    """Words covered by a 3-word window whose hash occurs twice or more in the
    array of window hashes (null: fewer than three words)."""
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        def again(x, k):
            return F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"]))
        # A window adds three words, less those that the one before it has covered.
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, i: F.struct(
            i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")))["n"]

    return F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), 0).otherwise(
        F.element_at(F.transform(F.array(placed), covered), 1))


def fit(counts: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, list[float]]:
    """Prior and rule accuracies by EM from (vote pattern, documents) counts."""
    rules = len(counts[0][0]) if counts else 0
    prior, accuracy = 0.7, [0.8] * rules
    for _ in range(rounds):
        good = total = 0.0
        right, votes = [0.0] * rules, [0.0] * rules
        for pattern, n in counts:
            p = probability(pattern, prior, accuracy)
            good, total = good + n * p, total + n
            for j, v in enumerate(pattern):
                if v:
                    votes[j] += n
                    right[j] += n * (p if v > 0 else 1 - p)
        # One pseudo-document on either side keeps the prior inside (0, 1).
        prior = min(0.95, max(0.05, (good + 1) / (total + 2)))
        accuracy = [min(0.99, max(0.55, (r + 1) / (n + 2))) for r, n in zip(right, votes)]
    return prior, accuracy


def probability(pattern, prior: float, accuracy) -> float:
    s = math.log(prior / (1 - prior)) + sum(v * math.log(a / (1 - a)) for v, a in zip(pattern, accuracy))
    return 1 / (1 + math.exp(-s))


def fit_corpus(counted: DataFrame, rules=RULES) -> tuple[float, list[float]]:
    """EM on the vote patterns of a whole table that has the counts."""
    votes = counted.select(*[r.vote().alias(f"v{j}") for j, r in enumerate(rules)])
    rows = votes.groupBy(*votes.columns).count().collect()  # at most 3^rules rows
    return fit(sorted((tuple(r[:-1]), r[-1]) for r in rows))


def judge(counted: DataFrame, model: tuple[float, list[float]], rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, votes (array in the order of the rules), quality (the
    posterior) and kept to a table that has the counts."""
    prior, accuracy = model
    score = F.lit(math.log(prior / (1 - prior)))
    for r, a in zip(rules, accuracy):
        score = score + r.vote() * F.lit(math.log(a / (1 - a)))
    d = drop_clashes(counted, ["base_failed", "votes", "quality", "kept"])
    d = d.withColumns({"base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
                       "votes": F.array(*[r.vote() for r in rules]), "quality": 1 / (1 + F.exp(-score))})
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, votes, quality,
    kept. Texts are read once: the counts are written to the checkpoint folder
    between the fit and the verdict."""
    counted = cut_lineage(add_counts(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    return judge(counted, fit_corpus(counted, rules), rules, threshold)


def keep_good(docs: DataFrame, text: str = "text", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns. The counts are made
    twice (fit and filter), which costs less than moving the texts."""
    model = fit_corpus(add_counts(docs.select(F.col(f"`{text}`").alias("text"))), rules)
    counted = add_counts(docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text")))
    # A filter is pushed through projections by writing their expressions out
    # at each use; it stops above a generator, so the counts are made once.
    once = counted.select("row", F.explode(F.array(F.struct(*COUNTS))).alias("c")).select("row", "c.*")
    return judge(once, model, rules, threshold).where("kept").select("row.*")
