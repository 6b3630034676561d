"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

1. Every word n-gram of a benchmark item is a seed, so every ``seed_words`` words in a row
   that a document leaves as they are hold one. A copy without such a run isn't found.
2. Where a document has seeds of an item, the item is aligned with the stretches of the
   document around them (match +2, mismatch -1, gap -1), unless a stretch holds too few
   of the item's words for the threshold whatever their order. similarity is the score over
   that of the whole item; pairs at ``min_similarity`` or more are returned. A stretch reaches
   as far to either side of a seed as any alignment at the threshold that holds the seed: an
   item's length and as many words as the threshold lets be wrong (twice the length at 0.5).

The seed index goes to the executors in parts of at most ``part_chars`` characters of
benchmark text; a larger benchmark takes one pass over the documents for each part.

Defined results for odd input: null or empty texts and items match nothing, nor do items
of fewer than ``seed_words`` words; an empty benchmark or an empty table gives an empty
result; rows without doc_id are aligned as any other and give rows without it; repeated
rows give repeated rows; items with the same item_id, or without one, are aligned each for
itself, and item_id may be of any type; equal scores take the earliest end in the document;
texts of any length are searched whole. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .kernel import Words, ngrams, slices

MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass(frozen=True)
class Params:
    seed_words: int = 4
    min_similarity: float = 0.5
    part_chars: int = 8_000_000


@dataclass(frozen=True)
class Index:
    """The items' words, and their seeds sorted by hash."""

    item_id: pa.Array
    words: np.ndarray
    first: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    quick: np.ndarray


def _quick(hashes: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << 22, bool)
    table[(hashes >> np.uint64(42)).astype(np.int64)] = True
    return table


def _find(hashes: np.ndarray, quick: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which grams are among the sorted hashes, and the first place of each there."""
    maybe = np.flatnonzero(quick[(grams >> np.uint64(42)).astype(np.int64)])
    at = np.searchsorted(hashes, grams[maybe])
    ok = at < len(hashes)
    ok[ok] = hashes[at[ok]] == grams[maybe[ok]]
    return maybe[ok], at[ok]


def build_index(items: pa.Table, p: Params) -> Index:
    """items: item_id and text."""
    items = items.combine_chunks()
    column = items["text"].combine_chunks().cast(pa.string())
    words = Words(column)
    grams, position = ngrams(words, p.seed_words)
    item = words.row()[position]
    at = np.argsort(grams, kind="stable")
    return Index(items["item_id"].combine_chunks(), words.hash, words.first, grams[at], item[at].astype(np.int32), _quick(grams))


def _last_row_best(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local score and where it ends: (score, words of the item, words of the text)."""
    best, ends = 0, (0, 0)
    row = np.zeros(len(text) + 1, np.int64)
    slope = np.arange(len(text) + 1) * -GAP
    for i, word in enumerate(item):
        now = np.zeros_like(row)
        now[1:] = np.maximum(row[:-1] + np.where(text == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(now, 0, out=now)
        row = np.maximum.accumulate(now + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, ends = int(row[top]), (i + 1, top)
    return best, *ends


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The best local alignment of two word sequences: (score, first and end word in the text)."""
    score, item_end, end = _last_row_best(item, text)
    if not score:
        return 0, 0, 0
    _, _, back = _last_row_best(item[:item_end][::-1], text[:end][::-1])
    return score, end - back, end


def matches(index: Index, words: Words, p: Params) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, similarity, first word, end word) of each row's and item's best alignment at or above the threshold."""
    grams, position = ngrams(words, p.seed_words)
    hit, at = _find(index.seed, index.quick, grams)
    if not len(hit):
        return
    n = np.searchsorted(index.seed, grams[hit], side="right") - at
    of = np.repeat(np.arange(len(hit)), n)
    item_of = index.item[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + at[of]].astype(np.int64)
    place = position[hit][of]
    row_of = np.searchsorted(words.first, place, side="right") - 1
    order = np.lexsort((place, item_of, row_of))
    row_of, item_of, place = row_of[order], item_of[order], place[order]
    cuts = np.flatnonzero(np.concatenate([[True], (row_of[1:] != row_of[:-1]) | (item_of[1:] != item_of[:-1]), [True]])).tolist()
    for a, b in zip(cuts, cuts[1:]):
        r, i = int(row_of[a]), int(item_of[a])
        item = index.words[index.first[i] : index.first[i + 1]]
        lo, hi = int(words.first[r]), int(words.first[r + 1])
        least = p.min_similarity * MATCH * len(item)
        reach = len(item) + int((MATCH * len(item) - least) / -GAP) + 1
        best = (0, 0, 0)
        apart = np.flatnonzero(np.diff(place[a:b]) > 2 * reach) + 1
        for seeds in np.split(place[a:b], apart):
            first, end = max(lo, int(seeds[0]) - reach), min(hi, int(seeds[-1]) + reach)
            # each match takes a word of the stretch that the item has, so this bounds the score
            if MATCH * np.count_nonzero(np.isin(words.hash[first:end], item)) < least:
                continue
            score, start, stop = align(item, words.hash[first:end])
            if score > best[0]:
                best = (score, first + start - lo, first + stop - lo)
        similarity = best[0] / (MATCH * len(item))
        if similarity >= p.min_similarity:
            yield r, i, similarity, best[1], best[2]


def _parts(benchmark: DataFrame, p: Params) -> list[DataFrame]:
    usable = benchmark.where(F.col("text").isNotNull()).select("item_id", "text")
    n = -(-(usable.agg(F.sum(F.length("text"))).first()[0] or 0) // p.part_chars)
    return [usable if n <= 1 else usable.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k) for k in range(n)]


def _index(part: DataFrame, p: Params) -> Index:
    return build_index(part.toArrow(), p)  # part_chars of text at most, or one item


def contaminated(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """doc_id, item_id, similarity, first_word, end_word of all copies of items in documents."""
    id_kind, item_kind = (df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {id_kind}, item_id {item_kind}, similarity double, first_word long, end_word long"

    def search(part: DataFrame) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(_index(part, params))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, column in slices(batch.column(1)):
                    found = list(matches(shared.value, Words(column), params))
                    if found:
                        row, item, similarity, start, end = zip(*found)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([first + r for r in row])), shared.value.item_id.take(pa.array(item)), pa.array(similarity, pa.float64()), pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                            names=["doc_id", "item_id", "similarity", "first_word", "end_word"],
                        )

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    found = [search(part) for part in _parts(benchmark, params)]
    return reduce(DataFrame.union, found) if found else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, all columns as they are; nothing is shuffled."""
    out = docs
    for part in _parts(benchmark, params):
        out = out.where(_clean(docs.sparkSession.sparkContext.broadcast(_index(part, params)), params)(F.col("text")))
    return out


def _clean(shared, params: Params):
    @F.arrow_udf("boolean")
    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            ok = np.ones(len(column), bool)
            for first, piece in slices(column):
                for found in matches(shared.value, Words(piece), params):
                    ok[first + found[0]] = False
            yield pa.array(ok)

    return clean


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
