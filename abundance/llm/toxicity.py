r"""Toxicity severity by cumulative-link ordinal regression (operator 1).

Model: grades 0 < 1 < ... < K share one weight vector w over sparse text
features and have ordered thresholds, P(grade <= k) = sigmoid(t_k - w.x). The
result is the expected severity, the sum over k of P(grade > k), and the most
probable grade.

Features: words (A-Z lower-cased; runs of ASCII letters, digits and non-ASCII
characters) and their beginnings are hashed into ``dims`` columns; a column's
value is log(1 + count) times its inverse document frequency in the sample, and
a document's vector has length one. Columns seen in fewer than ``min_docs``
documents of the sample do not count. In the fit, clean and toxic documents
weigh the same in sum.

The fit uses at most about ``max_rows`` labelled documents of ``max_bytes`` of
text in all (those with the smallest hashes of their id; a documented bound),
whole texts, on the driver: their feature vectors are made by tasks and
collected packed. The labels
table says toxic or not; ``severity_grades`` splits the toxic documents at
the median of their share of words that are far more frequent in toxic
documents, which gives grades 0 (clean), 1 and 2. Scoring covers all rows, in
one pass without a shuffle; two
numbers per column (4 bytes each) are broadcast.

Defined cases: null and empty texts have no features, so their score is the
model's intercept alone; unlabelled and null-labelled documents are not used
for the fit; an id counts once in it, however often its rows or labels repeat
(toxic if some label says so; its greatest text). Every row is scored. Without labelled
documents of both kinds every severity is 0. Input columns named like an
output are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from abundance.llm.common import as_bytes, map_rows
from abundance.llm.decontaminate import normalising_table

DIMS, MAX_ROWS, MAX_BYTES, MIN_DOCS, PREFIXES = 1 << 18, 8_000, 256 << 20, 3, (4, 6)


class Features:
    """Sparse vector of a text: columns and values. A word counts in its own
    column and in those of its beginnings of ``PREFIXES`` bytes, which stand
    for words not seen in the fit."""

    def __init__(self, dims: int):
        self.dims, self.table, self.columns = dims, normalising_table(), {}

    def of_word(self, w: bytes) -> list[int]:
        import xxhash

        parts = [w, *(b"^" + w[:k] for k in PREFIXES if len(w) > k)]
        found = self.columns[w] = [xxhash.xxh64_intdigest(p, 7) % self.dims for p in parts]
        return found

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        from collections import Counter

        if len(self.columns) > 200_000:
            self.columns.clear()
        get, cols, times = self.columns.get, [], []
        for w, n in (Counter(text.translate(self.table).split()) if text else {}).items():
            c = get(w) or self.of_word(w)
            cols += c
            times += [n] * len(c)
        cols, where = np.unique(np.array(cols, dtype=np.int64), return_inverse=True)
        return cols, np.log1p(np.bincount(where, times, len(cols)))


class Sparse:
    """Rows of sparse vectors."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(rows)
        self.cols = np.concatenate([c for c, _ in rows] or [np.zeros(0, np.int32)]).astype(np.int32)
        self.vals = np.concatenate([v for _, v in rows] or [np.zeros(0, np.float32)]).astype(np.float32)
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), [len(c) for c, _ in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.vals * w[self.cols], self.n)

    def transposed_dot(self, g: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.cols, self.vals * g[self.rows], dims)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: Sparse, grade: np.ndarray, dims: int, weight: np.ndarray | None = None, penalty: float = 1e-5, rounds: int = 300, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(w, thresholds) by penalised maximum likelihood (Adam, full batches).
    Thresholds are a first value and positive steps, so they stay ordered.
    ``weight`` is each row's weight, one by default."""
    k = int(grade.max())
    weight = np.ones(x.n) if weight is None else weight
    weight = weight / weight.sum()
    share = np.clip([weight[grade <= j].sum() for j in range(k)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    par = np.concatenate((np.zeros(dims), start[:1], np.log(np.maximum(np.diff(start), 1e-2))))
    m, v = np.zeros_like(par), np.zeros_like(par)
    for step in range(1, rounds + 1):
        w, t = par[:dims], np.cumsum(np.concatenate((par[dims:dims + 1], np.exp(par[dims + 1:]))))
        edges = np.concatenate(([-np.inf], t, [np.inf]))
        s = x.dot(w)
        upper, lower = sigmoid(edges[grade + 1] - s), sigmoid(edges[grade] - s)
        upper, lower = np.where(grade == k, 1.0, upper), np.where(grade == 0, 0.0, lower)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = weight * upper * (1 - upper) / p, weight * lower * (1 - lower) / p
        g = np.zeros_like(par)
        g[:dims] = x.transposed_dot(du - dl, dims) + penalty * w
        dt = np.array([dl[grade == j + 1].sum() - du[grade == j].sum() for j in range(k)])
        g[dims] = dt.sum()
        for j in range(1, k):
            g[dims + j] = dt[j:].sum() * np.exp(par[dims + j])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par = par - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8) * (1 - step / (rounds + 1))
    return par[:dims], np.cumsum(np.concatenate((par[dims:dims + 1], np.exp(par[dims + 1:]))))


def severity_grades(x: Sparse, toxic: np.ndarray, dims: int) -> np.ndarray:
    """Grades 0, 1, 2 from toxic flags: toxic documents above the median share
    of strongly toxic words are grade 2."""
    in_toxic = np.bincount(x.cols, toxic[x.rows], dims)
    in_all = np.bincount(x.cols, minlength=dims)
    n = toxic.sum()
    ratio = ((in_toxic + 0.5) / (n + 1)) / ((in_all - in_toxic + 0.5) / (len(toxic) - n + 1))
    strong = ((ratio > 8) & (in_toxic >= MIN_DOCS)).astype(np.float64)
    share = x.dot(strong)
    return np.where(toxic == 1, np.where(share > np.median(share[toxic == 1]), 2, 1), 0)


@dataclass
class Model:
    """Weights and scales (inverse document frequencies) by column, and the
    ordered thresholds."""
    weights: np.ndarray
    scales: np.ndarray
    thresholds: np.ndarray


def scaled(cols: np.ndarray, vals: np.ndarray, scales: np.ndarray) -> np.ndarray:
    v = vals * scales[cols]
    return v / (np.sqrt(v @ v) or 1.0)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
        dims: int = DIMS, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, min_docs: int = MIN_DOCS) -> Model:
    """The model of a bounded sample of labelled documents."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, max_rows / n) if n else 0.0
    chosen = known.where(place < F.lit(int((1 << 30) * share)))  # about max_rows rows
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    lengths = texts.select("doc_id", F.octet_length("text").alias("n")).join(F.broadcast(chosen), "doc_id")
    size = lengths.groupBy("doc_id").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0] or 0
    if size > max_bytes:
        chosen = known.where(place < F.lit(int((1 << 30) * share * max_bytes / size)))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text")).select("y", "text")

    def as_vectors(batches):
        import pyarrow as pa

        f = Features(dims)
        for b in batches:
            found = [f.of(t) for t in as_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.astype("<i4").tobytes() for c, _ in found], pa.binary()),
                                              pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], names=["y", "cols", "vals"])

    sample = sorted(map(tuple, rows.mapInArrow(as_vectors, "y int, cols binary, vals binary").collect()))
    toxic = np.array([r[0] for r in sample], dtype=np.int64)
    if len(set(toxic.tolist())) < 2:
        return Model(np.zeros(dims), np.zeros(dims), np.array([40.0, 80.0]))
    seen = np.zeros(dims, np.int64)
    for _, c, _ in sample:
        seen[np.frombuffer(c, "<i4")] += 1  # a document's columns are distinct
    scales = np.where(seen >= min_docs, np.log((1 + len(sample)) / (1 + seen)), 0.0)
    vectors = []
    while sample:  # the packed rows are freed as their vectors are made
        _, c, v = sample.pop()
        c, v = np.frombuffer(c, "<i4"), np.frombuffer(v, "<f4")
        use = scales[c] > 0
        vectors.append((c[use], scaled(c[use], v[use], scales).astype(np.float32)))
    x, toxic = Sparse(vectors), toxic[::-1]
    del vectors
    toxic = (toxic > 0).astype(np.int64)
    weight = np.where(toxic == 1, 1 / toxic.sum(), 1 / (1 - toxic).sum())
    w, t = fit_ordinal(x, severity_grades(x, toxic, dims), dims, weight)
    return Model(w, scales, t)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add expected_severity (double), severity (the most probable grade) and
    toxic (grade 1 or more is more probable than grade 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.weights.astype("<f4").tobytes(), model.scales.astype("<f4").tobytes(), model.thresholds.tolist()))
    fields = [T.StructField("expected_severity", T.DoubleType()), T.StructField("severity", T.IntegerType()), T.StructField("toxic", T.BooleanType())]

    def make():
        import pyarrow as pa

        w, scales = (np.frombuffer(x, "<f4").astype(np.float64) for x in shared.value[:2])
        t = np.array(shared.value[2])
        f = Features(len(w))

        def run(array):
            s = np.array([scaled(c, v, scales) @ w[c] if len(c) else 0.0 for c, v in map(f.of, as_bytes(array))])
            at_most = sigmoid(t[None, :] - s.reshape(-1, 1))
            p = np.diff(np.concatenate((np.zeros((len(s), 1)), at_most, np.ones((len(s), 1))), axis=1), axis=1)
            return [pa.array((1 - at_most).sum(axis=1)), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(at_most[:, 0] < 0.5)]

        return run

    return map_rows(docs, text, fields, make)
