"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are trained with follow-the-regularised-leader (per-coordinate FTRL-proximal
with L1 and L2), then one temperature is fitted on rows that training did not see.
Document frequencies come from every row; only the labelled rows that training reads
are a bounded sample (``train_rows``).

Defined results for odd input: a null or empty text, or one without any n-gram of the
vocabulary, has language null, confidence 0 and is rejected; a null label is never
trained on but its row is scored; with fewer than two labels among the sampled rows
nothing can be told apart, so each text with letters gets the one label there is
(null without any) at confidence 1 (0); labelled rows that agree in doc_id, text and lang
are one in the sample, and null or repeated ids change nothing else; languages that tie
go by their name; repeated rows give repeated results; texts of any length are read
whole; an empty table gives an empty result; columns other than doc_id, text and lang
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .kernel import code_points, slices

BUCKETS = 1 << 16
GRAMS = (1, 2, 3)


@dataclass(frozen=True)
class Params:
    train_rows: int = 3000
    held_out: float = 0.2
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001
    min_confidence: float = 0.4
    seed: int = 7


@dataclass(frozen=True)
class Model:
    classes: list
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, buckets, counts) of the character n-grams of all rows, on their whole texts; row i's are at bounds[i] .. bounds[i + 1]."""
    points, bounds = code_points(column)
    x = points.astype(np.uint32)
    letter = (x > 127) | ((x >= 97) & (x <= 122))
    x = np.where(letter, x, np.uint32(32))  # all that isn't a letter is one kind of gap
    wide = np.uint32 if len(column) < BUCKETS else np.uint64
    row = np.repeat(np.arange(len(column), dtype=wide), np.diff(bounds))
    told = np.diff(np.concatenate([[0], np.cumsum(letter)])[bounds]) > 0
    keys = []
    for n in GRAMS:
        h = np.zeros(max(0, len(x) - n + 1), np.uint32)
        for k in range(n):
            h = (h ^ x[k : len(x) - n + 1 + k]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        h = (h ^ np.uint32(n)) * np.uint32(0x85EBCA6B)
        own = row[: len(h)]
        whole = own == row[n - 1 :] if len(h) else np.zeros(0, bool)
        if not told.all():
            whole &= told[own]
        keys.append((own[whole] << wide(16)) | (h[whole] >> np.uint32(16)))
    key = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), key[1:] != key[:-1]]))
    count = np.diff(first, append=len(key))
    key = key[first]
    return np.searchsorted(key, np.arange(len(column) + 1, dtype=np.uint64) << np.uint64(16)), (key & wide(BUCKETS - 1)).astype(np.int64), count


def _vector(idf: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    value = (1 + np.log(count)) * idf[at]
    return value / max(float(np.sqrt(value @ value)), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, p: Params) -> Model:
    """FTRL-proximal over the rows in a seeded order, then the temperature on held-out rows."""
    classes = sorted({r[0] for r in rows})
    if len(classes) < 2:
        return Model(classes, idf, np.zeros((BUCKETS, len(classes)), np.float32), 1.0)
    data = [(classes.index(lang), at, _vector(idf, at, count)) for lang, at, count in rows]
    rng = np.random.default_rng(p.seed)
    order = rng.permutation(len(data))
    n_held = int(len(data) * p.held_out)
    held, fit = order[:n_held], order[n_held:]
    z = np.zeros((BUCKETS, len(classes)))
    n = np.zeros_like(z)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        za = z[at]
        return np.where(np.abs(za) <= p.l1, 0.0, -(za - np.sign(za) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    for _ in range(p.epochs):
        for i in rng.permutation(fit):
            y, at, value = data[i]
            w = weights(at)
            error = _softmax(value @ w)
            error[y] -= 1
            g = value[:, None] * error[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    temperature = 1.0
    if n_held:
        logits = np.array([data[i][2] @ w[data[i][1]] for i in held])
        truth = np.array([data[i][0] for i in held])
        # as many smoothed targets as rows: on separable rows the loss would fall for ever as t goes to 0
        target = np.full(logits.shape, 1 / (n_held + 2) / (len(classes) - 1))
        target[np.arange(n_held), truth] = (n_held + 1) / (n_held + 2)
        loss = lambda t: -(target * np.log(np.maximum(_softmax(logits / t), 1e-12))).sum(1).mean()
        temperature = float(min(np.geomspace(0.05, 20, 121), key=loss))
    return Model(classes, idf, w.astype(np.float32), temperature)


def score(model: Model, column: pa.Array) -> tuple[list, np.ndarray]:
    """The language and calibrated confidence of each row."""
    langs: list = [None] * len(column)
    confidence = np.zeros(len(column))
    if not model.classes:
        return langs, confidence
    for first, part in slices(column):
        bounds, at, count = features(part)
        rows = np.flatnonzero(np.diff(bounds))
        if not len(rows):
            continue
        start = bounds[rows]
        value = (1 + np.log(count)) * model.idf[at]
        length = np.sqrt(np.add.reduceat(value * value, start))
        logits = np.stack([np.add.reduceat(value * w[at], start) for w in model.weights.T], 1) / np.maximum(length, 1e-12)[:, None]
        p = _softmax(logits / model.temperature)
        best = p.argmax(1)
        confidence[first + rows] = p[np.arange(len(rows)), best]
        for i, k in zip((first + rows).tolist(), best.tolist()):
            langs[i] = model.classes[k]
    return langs, confidence


def fit(docs: DataFrame, params: Params = Params()) -> Model:
    """Document frequencies over all rows and a model from a bounded sample of those with a label.

    What comes back to the driver is the n-gram counts (as many as there are buckets) and
    the features of ``train_rows`` rows at most.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    chosen = common.sampled(labelled, ["doc_id", "text", "lang"], params.train_rows, params.seed)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2)):
                bounds, at, count = features(part)
                own = [(at[a:b].astype(np.uint16).tobytes(), count[a:b].astype(np.int32).tobytes()) for a, b in zip(bounds, bounds[1:])]
                columns = [batch.column(k).slice(first, len(part)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([o[k] for o in own], pa.binary()) for k in (0, 1)]], names=["hash", "lang", "at", "count"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            total += batch.num_rows
            for _, part in slices(batch.column(0)):
                seen += np.bincount(features(part)[1], minlength=BUCKETS)
        yield from common.count_rows(np.append(seen, total))

    counts = common.gathered(common.summed(docs.select("text").mapInArrow(partial, common.COUNTS_SCHEMA)).collect(), BUCKETS + 1)
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])) + 1
    found = sorted(chosen.select("__hash", "lang", "text").mapInArrow(sample, "hash long, lang string, at binary, count binary").collect())  # the same order on every run
    rows = [(r["lang"], np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["count"], np.int32).astype(np.int64)) for r in found]
    return train([r for r in rows if len(r[1])], idf, params)


def identify(docs: DataFrame, params: Params = Params(), model: Model | None = None) -> DataFrame:
    """doc_id, lang, predicted, confidence and accepted of every row of ``docs``.

    A document is accepted if its language is told with ``min_confidence`` or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, params))  # buckets x languages: no larger on more data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, confidence = score(shared.value, batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(confidence), pa.array(confidence >= params.min_confidence)],
                names=["doc_id", "lang", "predicted", "confidence", "accepted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("lang").cast("string"), "text").mapInArrow(run, f"doc_id {kind}, lang string, predicted string, confidence double, accepted boolean")


def keep_identified(docs: DataFrame, params: Params = Params(), model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is told with ``min_confidence``, all columns as they are.

    Only the text goes to Python; the rows stay in the JVM and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, params))

    @F.arrow_udf("boolean")
    def accepted(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            yield pa.array(score(shared.value, column)[1] >= params.min_confidence)

    return docs.where(accepted(F.col("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(common.table(spark, sf_dir, "documents"))
