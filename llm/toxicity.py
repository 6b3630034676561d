"""Toxicity by nearest labelled examples under exact TF-IDF cosine, over a block-max inverted index.

1. The vocabulary is every word of the sampled labelled rows; its document frequencies are
   counted over all documents. A document's vector is (1 + ln tf) * idf * sqrt(1 + chi2 /
   ``least_chi2``) over all its words, scaled to length 1; chi2 is that of a word's presence
   and the label among the sampled rows, so that words which tell the labels apart weigh more
   and none is left out; words beyond the vocabulary have the idf of none and add to the length.
2. Up to ``examples`` rows of each label make an inverted index. Examples that share their
   heaviest word lie together in blocks of ``BLOCK``; a term's postings are grouped by block,
   each group with its greatest value. Terms that more than one in ``DENSE`` examples hold are
   rows of a matrix instead, multiplied with many queries at once. A block's greatest such
   product and the greatest values of a query's other terms bound the cosines in the block, so
   the blocks of the highest bounds are summed first, and of the others only those whose bound
   reaches the k-th cosine found: the k nearest are exact (ties, to 12 digits: first example).
3. Neighbours vote by 1 / (distance + 0.1) times cosine, a neighbour's vote also weighed by
   how rare its label is among the examples, against ``prior_mass`` votes for the share of
   toxic rows; a logistic curve fitted on the sampled rows, each voted on by the others,
   turns the vote into a probability. The neighbours are given as evidence.

Only the labelled rows are a bounded sample (``labelled_rows``); every document is a query.
A document is never its own neighbour. Words are told apart by 64-bit hashes.

Defined results for odd input: null and empty texts, and texts without a word of the
examples, have no neighbours and the probability of a bare prior; labels that are null,
or whose document is missing, are not used; of several labels of one doc_id any toxic one
counts; rows of a labelled doc_id that are alike are one example; rows without doc_id are
scored as any other; repeated rows give repeated results; with no labelled rows, or all of
one label, there are no examples, toxic is false and the score is the share of toxic rows;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .kernel import Words, slices

#: Examples of one block.
BLOCK = 32
#: Blocks that are summed first.
FIRST = 4
DENSE = 10
#: Queries that are multiplied at once.
QUERIES = 256


@dataclass(frozen=True)
class Params:
    labelled_rows: int = 20_000
    examples: int = 2_000
    neighbours: int = 15
    least_chi2: float = 30.0
    prior_mass: float = 1.0
    threshold: float = 0.5
    seed: int = 4


@dataclass(frozen=True)
class Index:
    """The vocabulary with its weights, and the examples' postings grouped by term and block."""

    word: np.ndarray  # term -> hash, sorted
    idf: np.ndarray  # term -> weight; one more for all other words
    dense_of: np.ndarray  # term -> its row of dense, or -1
    dense: np.ndarray
    group_first: np.ndarray  # term -> its first group
    group_block: np.ndarray
    group_most: np.ndarray
    posting_first: np.ndarray  # group -> its first posting
    posting: np.ndarray  # example
    value: np.ndarray
    doc_id: list
    toxic: np.ndarray
    share: np.ndarray  # example -> what its vote counts
    prior: float
    curve: tuple[float, float] = (0.0, 0.0)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, word hashes, counts) of the different words of each row, on its whole text."""
    words = Words(column)
    order = np.lexsort((words.hash, words.row()))
    hashed, row = words.hash[order], words.row()
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])]))
    return np.searchsorted(row[first], np.arange(words.n + 1)), hashed[first], np.diff(first, append=len(row))


def _spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the spans first .. end - 1, one after another, and which span each is of."""
    n = end - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def lookup(vocabulary: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The place of each hash in the sorted vocabulary; its size for the hashes that aren't there."""
    if not len(vocabulary):
        return np.zeros(len(hashed), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashed, at, len(vocabulary))


def vectors(word: np.ndarray, idf: np.ndarray, bounds: np.ndarray, hashed: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row the terms of the vocabulary and their parts of the vector, whose length is that over all words."""
    term = lookup(word, hashed)
    value = (1 + np.log(count)) * idf[term]
    total = np.concatenate([[0.0], np.cumsum(value * value)])
    for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
        known = term[lo:hi] < len(word)
        yield term[lo:hi][known], value[lo:hi][known] / max(float(np.sqrt(value[lo:hi] @ value[lo:hi])), 1e-12) if hi > lo else value[lo:hi]


def search(index: Index, queries: Iterable[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each vector the k examples of the greatest positive cosine and these cosines, exactly, best first; how many blocks were summed."""
    queries = iter(queries)
    while part := list(islice(queries, QUERIES)):
        matrix = np.zeros((len(part), len(index.dense)))
        for own, (term, value) in zip(matrix, part):
            row = index.dense_of[term]
            own[row[row >= 0]] = value[row >= 0]
        for cosine, (term, value) in zip(matrix @ index.dense, part):
            yield _finished(index, cosine, term, value, k)


def _finished(index: Index, cosine: np.ndarray, term: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest, from the dense terms' part of the cosines."""
    n_blocks = len(cosine) // BLOCK
    group, of = _spans(index.group_first[term], index.group_first[term + 1])
    block, weight = index.group_block[group], value[of]
    bound = cosine.reshape(n_blocks, BLOCK).max(1) + np.bincount(block, weight * index.group_most[group], n_blocks)

    def add(which: np.ndarray) -> None:
        own = group[which[block]]
        posting, at = _spans(index.posting_first[own], index.posting_first[own + 1])
        if len(posting):
            cosine[:] += np.bincount(index.posting[posting], weight[which[block]][at] * index.value[posting], len(cosine))

    wanted = np.zeros(n_blocks, bool)
    wanted[np.argpartition(-bound, FIRST)[:FIRST] if n_blocks > FIRST else slice(None)] = True
    add(wanted)
    kth = np.partition(np.where(np.repeat(wanted, BLOCK), cosine, 0.0), -k)[-k] if len(cosine) >= k else 0.0
    rest = ~wanted & (bound > 0) & (bound >= kth - 1e-9)
    add(rest)
    wanted |= rest
    cosine = np.round(np.where(np.repeat(wanted, BLOCK), cosine, 0.0), 12)
    kth = np.partition(cosine, -k)[-k] if len(cosine) >= k else 0.0
    some = np.flatnonzero((cosine > 0) & (cosine >= kth))
    best = some[np.argsort(-cosine[some], kind="stable")][:k]
    return best, cosine[best], int(wanted.sum())


def nearest(index: Index, term: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    return next(search(index, [(term, value)], k))


def votes(index: Index, rows: Iterable[tuple[np.ndarray, np.ndarray]], ids: list, p: Params) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """For each row's vector the share of votes for toxic, before calibration, and the neighbours."""
    if not index.doc_id:
        yield from ((index.prior, np.zeros(0, np.int64), np.zeros(0)) for _ in ids)
        return
    for doc_id, (best, cosine, _) in zip(ids, search(index, rows, p.neighbours + 1)):
        other = np.array([doc_id is None or index.doc_id[i] != doc_id for i in best.tolist()], bool)
        best, cosine = best[other][: p.neighbours], cosine[other][: p.neighbours]
        weight = cosine / (1.1 - np.minimum(cosine, 1)) * index.share[best]
        yield float((weight @ index.toxic[best] + p.prior_mass * index.prior) / (weight.sum() + p.prior_mass)), best, cosine


@dataclass(frozen=True)
class Rows:
    """The sampled labelled rows, in a fixed order: row i's different words (their places in the vocabulary) and their counts are at bounds[i] .. bounds[i + 1]."""

    doc_id: list
    toxic: np.ndarray
    bounds: np.ndarray
    term: np.ndarray
    count: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_id), dtype=np.int32), np.diff(self.bounds))


def association(rows: Rows, n_terms: int) -> np.ndarray:
    """Chi-square of each word's presence and the label; rows of both labels."""
    term = rows.term
    n, n_toxic = len(rows.doc_id), int(rows.toxic.sum())
    held = np.bincount(term, minlength=n_terms).astype(float)
    a = np.bincount(term[rows.toxic[rows.row()] == 1], minlength=n_terms).astype(float)
    b = held - a
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(n * (a * (n - n_toxic - b) - b * (n_toxic - a)) ** 2 / (held * (n - held) * float(n_toxic) * (n - n_toxic)), posinf=0.0)


def build_index(rows: Rows, word: np.ndarray, seen: np.ndarray, total: int, p: Params) -> Index:
    """word: the hashes of the rows' words, sorted; seen: how many of all documents hold each."""
    prior = float(rows.toxic.mean()) if len(rows.doc_id) else 0.0
    idf = np.log((1 + total) / (1 + np.append(seen, 0))) + 1
    none = np.zeros(0, np.int64)
    index = Index(word, idf, np.full(len(word), -1), np.zeros((0, 0)), np.zeros(len(word) + 2, np.int64), none, np.zeros(0), np.zeros(1, np.int64), none, np.zeros(0), [], np.zeros(0), np.zeros(0), prior)
    if not 0 < prior < 1:
        return index
    term = rows.term
    idf[:-1] *= np.sqrt(1 + association(rows, len(word)) / p.least_chi2)
    value = np.log(rows.count)
    value += 1
    value *= idf[term]
    filled = np.flatnonzero(np.diff(rows.bounds))
    for a, b in zip(rows.bounds[filled].tolist(), rows.bounds[filled + 1].tolist()):
        value[a:b] /= np.sqrt(value[a:b] @ value[a:b])
    chosen = np.sort(np.concatenate([filled[rows.toxic[filled] == y][: p.examples] for y in (0, 1)]))
    if not len(chosen):
        return index
    own = [slice(rows.bounds[i], rows.bounds[i + 1]) for i in chosen]
    held = np.bincount(np.concatenate([term[o] for o in own]), minlength=len(word))

    def place(i: int) -> tuple:
        often = held[term[own[i]]] > 1
        return bool(rows.toxic[chosen[i]]), int(term[own[i]][often][value[own[i]][often].argmax()]) if often.any() else len(word)

    order = sorted(range(len(chosen)), key=place)  # stable
    chosen, own = chosen[order], [own[i] for i in order]
    example = np.repeat(np.arange(len(own), dtype=np.int32), [o.stop - o.start for o in own])
    of, weight = np.concatenate([term[o] for o in own]), np.concatenate([value[o] for o in own])
    often = np.flatnonzero(held * DENSE > len(own))
    dense_of = np.full(len(word), -1, np.int32)
    dense_of[often] = np.arange(len(often))
    dense = np.zeros((len(often), -(-len(own) // BLOCK) * BLOCK))
    is_dense = dense_of[of] >= 0
    dense[dense_of[of[is_dense]], example[is_dense]] = weight[is_dense]
    of, weight, example = of[~is_dense], weight[~is_dense], example[~is_dense]
    order = np.lexsort((example, of))
    of, weight, example = of[order], weight[order], example[order]
    block = example // BLOCK
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), (of[1:] != of[:-1]) | (block[1:] != block[:-1])]))
    labels = rows.toxic[chosen].astype(np.float64)
    rare = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    index = replace(
        index, dense_of=dense_of, dense=dense, group_first=np.searchsorted(of[first], np.arange(len(word) + 2)), group_block=block[first], group_most=np.maximum.reduceat(weight, first) if len(first) else np.zeros(0), posting_first=np.append(first, len(of)),
        posting=example, value=weight, doc_id=[rows.doc_id[i] for i in chosen], toxic=labels, share=rare,
    )
    # logistic calibration by Newton's steps with a small ridge; no row has itself among its neighbours
    each = ((term[a:b], value[a:b]) for a, b in zip(rows.bounds, rows.bounds[1:]))
    return replace(index, curve=calibration(np.array([share for share, _, _ in votes(index, each, rows.doc_id, p)]), rows.toxic.astype(float)))


def calibration(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the logistic curve of labels y over vote shares x."""
    x = np.stack([np.ones(len(x)), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (q * (1 - q))) @ x + 1e-2 * np.eye(2), x.T @ (q - y) + 1e-2 * w)
    return float(w[0]), float(w[1])


def probability(index: Index, share: float) -> float:
    if not index.doc_id:
        return index.prior
    return float(1 / (1 + np.exp(-(index.curve[0] + index.curve[1] * share))))


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params()) -> Index:
    """The index from a bounded sample of labelled rows and its words' counts over all documents."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = common.sampled(known, ["doc_id", "toxic"], params.labelled_rows, params.seed).drop("__hash")  # labelled_rows at most
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(known), "doc_id")
    rows = common.sampled(rows, ["doc_id", "text", "toxic"], params.labelled_rows, params.seed)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(3)):
                bounds, hashed, count = terms(part)
                own = [(hashed[a:b].tobytes(), count[a:b].astype(np.int32).tobytes()) for a, b in zip(bounds, bounds[1:])]
                columns = [batch.column(k).slice(first, len(part)) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array([o[k] for o in own], pa.binary()) for k in (0, 1)]], names=["hash", "doc_id", "toxic", "words", "counts"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("doc_id", "toxic")}
    found = rows.select("__hash", "doc_id", "toxic", "text").mapInArrow(sample, f"hash long, doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, words binary, counts binary")
    found, word = gathered(found.toLocalIterator())  # a partition at a time
    shared = docs.sparkSession.sparkContext.broadcast(word)  # words of labelled_rows rows

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(shared.value) + 2, np.int64)  # of each word, of the others, of rows
        for batch in batches:
            seen[-1] += batch.num_rows
            for _, part in slices(batch.column(0)):
                seen[:-1] += np.bincount(lookup(shared.value, terms(part)[1]), minlength=len(seen) - 1)
        yield from common.count_rows(seen)

    counts = common.gathered(common.summed(docs.select("text").mapInArrow(partial, common.COUNTS_SCHEMA)).collect(), len(word) + 2)
    return build_index(found, word, counts[:-2], int(counts[-1]), params)


def gathered(found: Iterator) -> tuple[Rows, np.ndarray]:
    """The sampled rows and the sorted hashes of their words, from rows of hash, doc_id, toxic, words and counts."""
    own = sorted(((r["hash"], r["doc_id"], int(bool(r["toxic"])), np.frombuffer(r["words"], np.uint64), np.frombuffer(r["counts"], np.int32)) for r in found), key=lambda r: r[0])
    ids, toxic, sizes = [r[1] for r in own], np.array([r[2] for r in own], np.int8), [len(r[3]) for r in own]
    hashed, count = np.concatenate([np.zeros(0, np.uint64), *[r[3] for r in own]]), np.concatenate([np.zeros(0, np.int32), *[r[4] for r in own]])
    own.clear()
    word = np.unique(hashed)
    return Rows(ids, toxic, np.cumsum([0, *sizes]), np.searchsorted(word, hashed).astype(np.int32), count), word


def score(docs: DataFrame, labels: DataFrame, params: Params = Params(), index: Index | None = None) -> DataFrame:
    """doc_id, score (the probability), toxic, and evidence: neighbours' doc_id, cosine and label, nearest first."""
    shared = docs.sparkSession.sparkContext.broadcast(index or fit(docs, labels, params))  # of bounded size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            scores, near, cosines, sizes = [], [], [], []
            for first, part in slices(batch.column(1)):
                for share, best, cosine in votes(index, vectors(index.word, index.idf, *terms(part)), ids[first : first + len(part)], params):
                    scores.append(probability(index, share))
                    near.append(best)
                    cosines.append(cosine)
                    sizes.append(len(best))
            scored = np.array(scores)
            near = np.concatenate([np.zeros(0, np.int64), *near]).astype(np.int64)
            fields = [pa.array([index.doc_id[i] for i in near.tolist()], batch.column(0).type), pa.array(np.concatenate([np.zeros(0), *cosines])), pa.array(index.toxic[near].astype(bool) if len(near) else [], pa.bool_())]
            evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.StructArray.from_arrays(fields, names=["doc_id", "cosine", "toxic"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scored, pa.float64()), pa.array((scored >= params.threshold) & bool(index.doc_id), pa.bool_()), evidence], names=["doc_id", "score", "toxic", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, toxic boolean, evidence array<struct<doc_id: {kind}, cosine: double, toxic: boolean>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
