"""Token ids as Simple-8b: 64-bit words of one 4-bit selector and as many ids as fit.

Ids are cut in blocks of ``BLOCK``; a word never spans blocks, and each block's first word
has its offset stored, so blocks decode independently and in vectorised steps. A value of
2^60 or more is escaped: a word of selector 0, then the value as a raw word. A word at the
end of a block may have fewer ids than its selector says; the rest of it is zero.

Defined results for odd input: a null or empty text has 0 tokens, no blocks, no words;
rows without doc_id and repeated rows are encoded as any other; an empty table gives an
empty result; columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, tokens
from .kernel import slices

BLOCK = 256
#: (ids, bits of each) by selector; 0 is the escape.
SELECTORS = [(1, 64), (240, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
_PAD = 240
_U = np.uint64


def _widths(values: np.ndarray) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    rest = values.copy()
    while rest.any():
        out += rest > 0
        rest >>= _U(1)
    return out


def _windows_max(width: np.ndarray, n: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """The largest of each n widths in a row, from the windows that are known."""
    if n not in known:
        half = max(k for k in known if k < n)
        if 2 * half < n:
            half = (n + 1) // 2
            _windows_max(width, half, known)
        step, base = n - half, known[half]
        out = base.copy()
        np.maximum(base[:, :-step], base[:, step:], out=out[:, :-step])
        known[n] = out
    return known[n]


def encode(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word bounds of rows, offsets of blocks within their row's words, block bounds of rows)."""
    n_rows = len(bounds) - 1
    length = np.diff(bounds)
    per_row = -(-length // BLOCK)
    block_bounds = np.concatenate([[0], np.cumsum(per_row)])
    n = int(block_bounds[-1])
    if not n:
        return np.zeros(0, _U), np.zeros(n_rows + 1, np.int64), np.zeros(0, np.uint32), block_bounds
    row = np.repeat(np.arange(n_rows), per_row)
    nth = np.arange(n) - block_bounds[row]
    begin = bounds[row] + nth * BLOCK
    size = np.minimum(BLOCK, bounds[row + 1] - begin)
    value = np.zeros((n, BLOCK + _PAD), _U)
    inside = np.arange(BLOCK)[None, :] < size[:, None]
    value[:, :BLOCK][inside] = ids[(begin[:, None] + np.arange(BLOCK)[None, :])[inside]]
    width = _widths(value)
    known = {1: width}
    choice = np.zeros((n, BLOCK), np.uint8)
    widest = int(width.max())
    for selector in range(15, 0, -1):
        count, bits = SELECTORS[selector]
        if selector < 15 and SELECTORS[selector + 1][0] <= count and bits > widest and SELECTORS[selector - 1][1] >= widest:
            continue  # the next one takes more of these
        fits = _windows_max(width, count, known)[:, :BLOCK] <= bits
        choice[fits] = selector
    takes = np.array([c for c, _ in SELECTORS])
    at, live = np.zeros(n, np.int64), np.arange(n)
    blocks, places = [], []
    while len(live):
        blocks.append(live)
        places.append(at[live])
        at[live] += takes[choice[live, at[live]]]
        live = live[at[live] < size[live]]
    block, place = np.concatenate(blocks), np.concatenate(places)
    order = np.argsort(block, kind="stable")
    block, place = block[order], place[order]
    selector = choice[block, place]
    escaped = selector == 0
    words = np.zeros(len(block), _U)
    for s in range(1, 16):
        own = np.flatnonzero(selector == s)
        if len(own):
            count, bits = SELECTORS[s]
            word = np.full(len(own), s << 60, _U)
            if bits:
                for k in range(count):
                    word |= value[block[own], place[own] + k] << _U(k * bits)
            words[own] = word
    if escaped.any():
        copies = 1 + escaped
        raw = np.cumsum(copies)[escaped] - 1
        words = np.repeat(words, copies)
        words[raw] = value[block[escaped], place[escaped]]
        block = np.repeat(block, copies)
    word_bounds = np.searchsorted(block, block_bounds)
    offsets = (np.searchsorted(block, np.arange(n)) - word_bounds[row]).astype(np.uint32)
    return words, word_bounds, offsets, block_bounds


def decode(words: np.ndarray, offsets: np.ndarray, n_tokens: int) -> np.ndarray:
    """The ids of one row."""
    out = np.zeros(n_tokens, _U)
    if not n_tokens:
        return out
    selector = (words >> _U(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == 0).tolist():
        if not raw[i]:
            raw[i + 1] = True
    lead = np.flatnonzero(~raw)
    s = selector[lead]
    count = np.array([c for c, _ in SELECTORS])[s]
    block = np.searchsorted(offsets, lead, side="right") - 1
    total = np.cumsum(count) - count
    start = total - total[np.searchsorted(block, np.arange(len(offsets)))][block] + block * BLOCK
    end = np.minimum(n_tokens, (block + 1) * BLOCK)
    for k in np.unique(s).tolist():
        own = np.flatnonzero(s == k)
        n, bits = SELECTORS[k]
        if k == 0:
            out[start[own]] = words[lead[own] + 1]
        elif bits:
            mask = _U((1 << bits) - 1)
            for j in range(n):
                ok = own[start[own] + j < end[own]]
                out[start[ok] + j] = (words[lead[ok]] >> _U(j * bits)) & mask
    return out


def token_binary(docs: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_blocks, offsets (uint32, one a block) and words (uint64) of each row, little-endian."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.tokenizer(vocabulary)
        for batch in batches:
            for first, column in slices(batch.column(1)):
                ids, bounds = encoder.encode(column)
                words, word_bounds, offsets, block_bounds = encode(ids, bounds)
                cut = lambda data, at: pa.array([data[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(column)), pa.array(np.diff(bounds)), pa.array(np.diff(block_bounds)), cut(offsets, block_bounds), cut(words, word_bounds)],
                    names=["doc_id", "n_tokens", "n_blocks", "offsets", "words"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_blocks long, offsets binary, words binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary(common.table(spark, sf_dir, "documents"))
