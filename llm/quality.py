"""Quality rules: hashed word and character n-gram logistic regression with fixed thresholds.

Features are the shares, within a text, of its hashed words and word pairs (as written,
so capitals count) and of its hashed character trigrams. The weights are trained by
AdaGrad on a bounded sample of rows with a quality label (``labelled_rows``), and Platt
scaling on sampled rows that training did not see turns scores into probabilities.
Rows are scored in Arrow batches on whole texts; the verdict follows fixed thresholds:
``keep`` from ``keep_at``, ``review`` from ``review_at``, else ``drop``; kept is true
for all but ``drop``.

Defined results for odd input: a null text, or one without any character, has
probability null, verdict ``drop``; labels that are null or without a document are not
used, and the least of several labels of one doc_id counts; rows of a labelled doc_id
that are alike are one in the sample; rows without doc_id are scored as any other; repeated rows give repeated results; with sampled labels all alike
every text has that label's probability (without any label 1); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .kernel import Words, code_points, ngrams, slices

BUCKETS = 1 << 18


@dataclass(frozen=True)
class Params:
    labelled_rows: int = 8_000
    held_out: float = 0.3
    epochs: int = 6
    rate: float = 0.5
    l2: float = 1e-6
    keep_at: float = 0.5
    review_at: float = 0.25
    seed: int = 5


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    scale: float
    shift: float


def hashed(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature the buckets of all rows, and the n + 1 row bounds in them."""
    words = Words(column, lower=False)
    single = (words.hash & np.uint64(BUCKETS - 1)).astype(np.int64)
    pair, position = ngrams(words, 2)
    pair_bounds = np.searchsorted(position, words.first)
    points, bounds = code_points(column, lower=False)
    x = points.astype(np.uint32)
    n = max(0, len(x) - 2)
    h = ((x[:n] * np.uint32(0x9E3779B1) ^ x[1 : n + 1]) * np.uint32(0x85EBCA6B) ^ x[2:]) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    within = np.ones(n, bool)
    for cut in bounds[1:-1]:
        within[max(0, cut - 2) : cut] = False
    grams = (h[within] & np.uint32(BUCKETS - 1)).astype(np.int64)
    gram_bounds = np.concatenate([[0], np.cumsum(within)])[np.minimum(bounds, n)]
    return [(single, words.first), ((pair & np.uint64(BUCKETS - 1)).astype(np.int64), pair_bounds), (grams, gram_bounds)]


def raw_scores(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    """Sum over the kinds of features of their mean weight."""
    out = np.zeros(len(column))
    for bucket, bounds in hashed(column):
        total = np.concatenate([[0.0], np.cumsum(weights[bucket], dtype=np.float64)])
        out += (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)
    return out


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each row."""
    kinds = hashed(column)
    for i in range(len(column)):
        at, share = [], []
        for bucket, bounds in kinds:
            own, count = np.unique(bucket[bounds[i] : bounds[i + 1]], return_counts=True)
            at.append(own)
            share.append(count / max(count.sum(), 1))
        yield np.concatenate(at), np.concatenate(share)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], p: Params) -> Model:
    """rows: (label, buckets, shares), in a fixed order."""
    labels = {r[0] for r in rows}
    if len(labels) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 30.0 if labels != {0} else -30.0)
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(len(rows))
    n_held = int(len(rows) * p.held_out)
    held, fit = order[:n_held], order[n_held:]
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    for _ in range(p.epochs):
        for i in rng.permutation(fit):
            y, at, share = rows[i]
            z = float(w[at] @ share)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share + p.l2 * w[at]
            np.add.at(seen, at, g * g)
            np.add.at(w, at, -p.rate * g / np.sqrt(seen[at]))
    if len({rows[i][0] for i in held}) < 2:
        held = order
    x = np.array([w[rows[i][1]] @ rows[i][2] for i in held])
    truth = np.array([rows[i][0] for i in held])
    n_good, n_bad = truth.sum(), len(truth) - truth.sum()
    y = np.where(truth == 1, (n_good + 1) / (n_good + 2), 1 / (n_bad + 2))
    x = np.stack([np.ones(len(x)), x], 1)
    ab = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        ab -= np.linalg.solve((x.T * np.maximum(q * (1 - q), 1e-6)) @ x + 1e-6 * np.eye(2), x.T @ (q - y))
    return Model(w.astype(np.float32), float(ab[1]), float(ab[0]))


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Model:
    """A model from a bounded sample of the labelled rows; the sample's features are what comes to the driver."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = common.sampled(known, ["doc_id", "quality"], params.labelled_rows, params.seed).drop("__hash")  # labelled_rows at most
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), "doc_id")
    rows = common.sampled(rows, ["doc_id", "text", "quality"], params.labelled_rows, params.seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_pylist()
            for first, part in slices(batch.column(0)):
                for i, (at, share) in enumerate(features(part), first):
                    yield pa.RecordBatch.from_arrays([pa.array([int(bool(y[i]))]), pa.array([at.astype(np.int32).tobytes()]), pa.array([share.astype(np.float32).tobytes()])], names=["y", "at", "share"])

    found = rows.select("text", "quality").mapInArrow(run, "y long, at binary, share binary").collect()
    found = [(r["y"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32)) for r in found]
    found.sort(key=lambda r: (r[1].tobytes(), r[2].tobytes(), r[0]))
    return train(found, params)


def score(docs: DataFrame, labels: DataFrame, params: Params = Params(), model: Model | None = None) -> DataFrame:
    """doc_id, quality (probability of a good text), verdict and kept of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, params))  # of fixed size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column(1)
            z = np.concatenate([np.zeros(0), *[raw_scores(model.weights, part) for _, part in slices(column)]])
            q = 1 / (1 + np.exp(-np.clip(model.scale * z + model.shift, -30, 30)))
            none = np.array([not t for t in column.to_pylist()], bool)
            verdict = np.where(q >= params.keep_at, "keep", np.where(q >= params.review_at, "review", "drop")).astype(object)
            verdict[none] = "drop"
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q, mask=none), pa.array(verdict, pa.string()), pa.array(verdict != "drop", pa.bool_())], names=["doc_id", "quality", "verdict", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, quality double, verdict string, kept boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
