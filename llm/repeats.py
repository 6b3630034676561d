"""Maximal repeats across documents from the common-prefix interval trees of suffix arrays.

A maximal repeat is a sequence of ``min_words`` words or more whose occurrences differ in
the word before them and in the word after them (a text's start or end differs from all).
All of them are found, each with all its occurrences:

1. *Anchors.* Of every w consecutive k-grams of words the least hash is an anchor, with
   w + k - 1 = ``min_words``; so each repeat holds an anchor that all its occurrences have at
   the same place. Anchors are a small share of the positions.
2. *Left diversity, first.* Occurrences of an anchor are brought together with what the
   anchor before them is and how far. An anchor that occurs once is the first of no repeat;
   where all occurrences have the same anchor before them, that one takes its repeats over.
   Only the rest, mostly the first anchors of copied stretches, go on.
3. *Enhanced suffix arrays.* For each of these the suffixes of its occurrences are sorted,
   with the lengths of neighbours' common prefixes. A suffix ends behind an anchor that occurs
   nowhere else, where any common prefix would make it occur again. Suffixes that start
   up to w - 1 words before the anchor are sorted likewise, class by class of equal words.
4. *Interval tree.* A stack scan gives the tree of intervals of common prefixes; an interval
   whose left words differ is a maximal repeat. It is reported once: at the first anchor that
   its own words make one, or at the one that took over from that.

Texts that are alike are sorted as two copies, which have the repeats of any number of them,
and the others are joined to the result; so a text with any number of copies is no larger.

One row is one occurrence of an outermost interval: ``repeat`` names the interval, n_words is
what all its occurrences share, doc_id and start (a word position) tell where, and rank is the
place in suffix order (that of the copy that was sorted, for the others). ``groups`` lists the
maximal repeats in the interval that begin at this rank, as their n_words and last rank: so each
is listed once, and its occurrences are the rows of the interval from its first to its last rank.

Words are compared by 32-bit hashes, k-grams by 64-bit hashes, whole texts by 128 bits.

Defined results for odd input: null and empty texts and texts of fewer than ``min_words``
words have no repeats; repeats within one text count, and rows that are alike, or share a
doc_id, are occurrences each; a null doc_id is null in the result; texts of any length and
any period are compared whole; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .kernel import Words, mix, ngrams, slices

#: Bytes of suffixes that sorting copies at a time.
SORT_BYTES = 1 << 24


@dataclass(frozen=True)
class Params:
    min_words: int = 50

    @property
    def window(self) -> int:
        return max(1, self.min_words // 2)

    @property
    def gram(self) -> int:
        return self.min_words - self.window + 1

    @property
    def bits(self) -> int:
        return (2 * self.window + 1).bit_length()


def _sliding(x: np.ndarray, n: int, best: np.ufunc) -> np.ndarray:
    """best of each n values in a row; len(x) - n + 1 results."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def anchors(words: Words, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of all anchors of a slice, positions counted over the slice."""
    grams, position = ngrams(words, p.gram)
    bounds = np.searchsorted(position, words.first)
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, hi in zip(bounds, bounds[1:]):
        if hi - lo >= p.window:
            h = grams[lo:hi]
            least = _sliding(h, p.window, np.minimum)
            edge = np.zeros(p.window - 1, np.uint64)
            chosen = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), p.window, np.maximum) == h)
            hashes.append(h[chosen])
            places.append(position[lo + chosen])
    return np.concatenate(hashes), np.concatenate(places)


def runs(grams: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """How many k-grams in a row before and after each anchor, w - 1 at most, aren't less than it; all numbered alike."""
    out = []
    for step in (-1, 1):
        n, on = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for d in range(1, p.window):
            there = at + step * d
            on &= (there >= lo) & (there < hi)
            on[on] = grams[there[on]] >= grams[at[on]]
            n += on
        out.append(n)
    return out[0], out[1]


def packed(distance: np.ndarray, before: np.ndarray, after: np.ndarray, diverse: np.ndarray, p: Params) -> bytes:
    """Distance, runs and diversity of anchors, each in one number of as few bytes as the window allows."""
    b = p.bits
    return ((distance + p.window) << 2 * b + 1 | before << b + 1 | after << 1 | diverse).astype(np.uint32 if 3 * b < 32 else np.int64).tobytes()


def unpacked(around: bytes, p: Params) -> list[tuple[int, int, int, int]]:
    b = p.bits
    low = (1 << b) - 1
    return [((x >> 2 * b + 1) - p.window, x >> b + 1 & low, x >> 1 & low, x & 1) for x in np.frombuffer(around, np.uint32 if 3 * b < 32 else np.int64).tolist()]


def reports(rows: list[tuple[int, int, int, int]], depth: int, n_words: int, window: int, gram: int) -> bool:
    """Whether a repeat from ``depth`` words before an anchor on is that anchor's to report.

    rows: distance, runs and diversity of the anchors near it in order, itself at distance 0.
    Beyond window + gram - 1 + window - 1 words the length makes no difference.
    """
    first, last = -depth, n_words - depth - gram
    for i, (d, before, after, _) in enumerate(rows):
        if first <= d <= last and min(before, d - first) + 1 + min(after, last - d) >= window:
            while i >= 0 and not rows[i][3]:
                i -= 1
            return i >= 0 and rows[i][0] == 0
    return False


def _prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two suffixes have in common."""
    n = min(len(a), len(b))
    differ = a[:n] != b[:n]
    at = int(differ.argmax()) if n else 0
    return at if n and differ[at] else n


def suffix_order(texts: list[np.ndarray], text: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes text[first:end], and the common prefix of each with the one before it.

    Suffixes are sorted by a block of words; those that tie, by the next block, and so on. A
    block is as long as ``SORT_BYTES`` for all that tie allow, so no more is copied at a time.
    """
    views = [texts[t][a:b] for t, a, b in zip(text.tolist(), first.tolist(), end.tolist())]
    order = list(range(len(views)))
    todo = [(0, len(views), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        block = max(16, SORT_BYTES // 4 // (hi - lo))
        keyed = sorted((views[i][depth : depth + block].tobytes(), i) for i in order[lo:hi])
        order[lo:hi] = [i for _, i in keyed]
        run = 0
        for k in range(1, hi - lo + 1):
            if k == hi - lo or keyed[k][0] != keyed[run][0]:
                if k - run > 1 and len(keyed[run][0]) == 4 * block:
                    todo.append((lo + run, lo + k, depth + block))
                run = k
    shared = [0] + [_prefix(views[i], views[j]) for i, j in zip(order, order[1:])]
    return np.array(order), np.array(shared)


def _between(shared: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The common prefix of each two of ``own`` that follow each other: the least of those between."""
    cuts = np.stack([own[:-1] + 1, own[1:] + 1], 1).ravel()
    if len(cuts) and cuts[-1] == len(shared):
        cuts = cuts[:-1]
    return np.minimum.reduceat(shared, cuts)[::2] if len(cuts) else np.zeros(0, np.int64)


def intervals(shared: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of all intervals of the tree, by a stack scan; inner before outer. shared[0] is not read."""
    stack: list[tuple[int, int]] = []
    n = len(shared)
    for i in range(1, n + 1):
        now, low = shared[i] if i < n else -1, i - 1
        while stack and stack[-1][0] > now:
            length, low = stack.pop()
            yield length, low, i - 1
        if not stack or stack[-1][0] < now:
            stack.append((now, low))


def repeats_at(texts: list[np.ndarray], text: np.ndarray, at: np.ndarray, low: np.ndarray, end: np.ndarray, around: list, p: Params) -> Iterator[tuple[np.ndarray, int, list]]:
    """Maximal repeats that this anchor has to report: (occurrences, words before the anchor, [(n_words, first, last)]).

    Occurrence i is at ``at[i]`` in ``texts[text[i]]``, whose words from ``low`` on are its text's, and whose
    suffix goes up to ``end``; ``around[i]`` is as from ``packed``.
    """
    order, shared = suffix_order(texts, text, at, end)
    text, at, low = text[order], at[order], low[order]
    left = np.empty((len(order), p.window), np.int64)
    used, where = np.unique(text, return_inverse=True)
    flat = np.concatenate([texts[t] for t in used.tolist()])
    offset = np.concatenate([[0], np.cumsum([len(texts[t]) for t in used.tolist()])])[where]
    for d in range(p.window):
        there = at - 1 - d
        inside = there >= low
        left[:, d] = -1 - np.arange(len(order))  # a start differs from all
        left[inside, d] = flat[(offset + there)[inside]]
    around = [around[i] for i in order.tolist()]
    least, enough, width = p.min_words, p.min_words + p.window - 1, p.window
    gram = p.gram
    memo: dict[tuple, bool] = {}
    decoded: dict[bytes, list] = {}

    def here(i: int, n: int, depth: int) -> bool:
        own = around[i]
        key = (own, depth, n if n < enough else enough)
        if key not in memo:
            if own not in decoded:
                decoded[own] = unpacked(own, p)
            memo[key] = reports(decoded[own], depth, n, width, gram)
        return memo[key]

    todo = [(np.arange(len(order)), 0)]
    while todo:
        own, depth = todo.pop()
        words = left[own, depth:]
        differs = (words != words[0]).any(0)
        if not differs.any():
            continue  # all have an anchor in common further left
        depth += int(differs.argmax())
        near = _between(shared, own)
        word = left[own, depth]
        changes = np.concatenate([[0], np.cumsum(word[1:] != word[:-1])]).tolist()
        found = [
            (depth + length, a, b)
            for length, a, b in intervals([0, *near.tolist()])
            if length + depth >= least and changes[a] != changes[b] and here(own[a], depth + length, depth)
        ]
        outer: list[tuple[int, int]] = []
        for _, a, b in sorted(found, key=lambda f: (f[1], -f[2])):
            if not outer or a > outer[-1][1]:
                outer.append((a, b))
        for a, b in outer:
            inner = sorted((n, x - a, y - a) for n, x, y in found if a <= x and y <= b)
            yield order[own[a : b + 1]], depth, inner
        by_word = np.argsort(word, kind="stable")
        cuts = np.flatnonzero(np.diff(word[by_word])) + 1
        todo += [(np.sort(own[part]), depth + 1) for part in np.split(by_word, cuts) if len(part) > 1 and depth + 1 < width]


def copies(rows: DataFrame, row: str) -> DataFrame:
    """other, doc_id, head: the rows whose text is that of the row ``head``, but for each text's first and last row."""
    hashed = rows.where("text IS NOT NULL").select(row, "doc_id", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    ends = hashed.groupBy("h", "g").agg(F.min(row).alias("head"), F.max(row).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 2").drop("n")
    return hashed.join(ends, ["h", "g"]).where((F.col(row) != F.col("head")) & (F.col(row) != F.col("last"))).select(F.col(row).alias("other"), "doc_id", "head")


def pieces(docs: DataFrame, row: str, others: DataFrame, p: Params) -> DataFrame:
    """The words around the anchors that may report a repeat, with these anchors' places; ``target`` is the anchor."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in slices(batch.column(1)):
                words = Words(column)
                hashed, position = anchors(words, p)
                if not len(hashed):
                    continue
                of = words.row()[position]
                ids = batch.column(0).slice(first, len(column)).to_numpy()
                start = np.diff(of, prepend=-1) != 0
                back = np.where(start, 0, np.diff(position, prepend=0))
                context = mix(np.where(start, ids[of].astype(np.uint64), np.concatenate([[np.uint64(0)], hashed[:-1]])) + mix(back.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashed.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[of]), pa.array((position - words.first[of]).astype(np.int32))], names=["anchor", "context", "row", "at"]
                )

    found = docs.select(row, "text").mapInArrow(scan, "anchor long, context long, row long, at int")
    # counts first, each task's own added up before the shuffle; the occurrences are joined to the anchors that come again
    counts = found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("least"), F.max("context").alias("most"))
    counts = counts.where("n > 1").select("anchor", (F.col("least") != F.col("most")).alias("diverse"))
    again = (
        found.select("anchor", "row", "at")
        .join(counts.hint("shuffle_hash"), "anchor")
        .groupBy(F.col("row").alias(row))
        .agg(F.sort_array(F.collect_list(F.struct("at", "diverse"))).alias("anchors"))
        .where(F.exists("anchors", lambda a: a["diverse"]))
        .join(others.select(F.col("other").alias(row)).hint("shuffle_hash"), row, "left_anti")
    )
    joined = docs.join(again.hint("shuffle_hash"), row)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column in slices(batch.column(1)):
                words = Words(column)
                hashed, position = anchors(words, p)
                bounds = np.searchsorted(position, words.first)
                grams, gram_at = ngrams(words, p.gram)
                of = words.row()[position]
                edges = np.searchsorted(gram_at, words.first)
                run = runs(grams, edges[of], edges[of + 1], np.searchsorted(gram_at, position), p)
                words32 = (words.hash >> np.uint64(32)).astype(">u4")
                which, target, low, data, marks = [], [], [], [], []
                lists = batch.column(2).slice(first, len(column))
                for i, own in enumerate(lists.to_pylist()):
                    text = words32[words.first[i] : words.first[i + 1]]
                    h, at = hashed[bounds[i] : bounds[i + 1]], position[bounds[i] : bounds[i + 1]] - words.first[i]
                    known = {a["at"]: a["diverse"] for a in own}
                    before, after = (x[bounds[i] : bounds[i + 1]] for x in run)
                    diverse = np.array([known.get(a, True) for a in at.tolist()], np.int64)
                    # an anchor that occurs once, and from where on any repeat would have it as its own
                    single = [(a, a - max(0, p.window - 1 - r)) for a, r in zip(at.tolist(), after.tolist()) if a not in known]
                    open_rows: dict[int, int] = {}
                    for k, a in enumerate(at.tolist()):
                        if not known.get(a):
                            continue
                        end = len(text)
                        for q, since in single[bisect.bisect(single, (a, len(text))) :]:
                            if since >= a:
                                end = min(end, since + p.window - 1 + p.gram)
                                break
                        t, b = int(h[k].view(np.int64)), max(0, a - p.window)
                        x, y = np.searchsorted(at, [a - p.window, a + p.window + 1])
                        own_near = packed(at[x:y] - a, before[x:y], after[x:y], diverse[x:y], p)
                        r = open_rows.get(t)
                        if r is None or low[r][1] < b:
                            r = open_rows[t] = len(which)
                            which.append(first + i)
                            target.append(t)
                            low.append([b, end])
                            marks.append([])
                        low[r][1] = max(low[r][1], end)
                        marks[r].append((a, end, own_near))
                    for r in range(len(data), len(which)):
                        data.append(text[low[r][0] : low[r][1]].tobytes())
                if which:
                    fields = [pa.array([[m[f] for m in x] for x in marks], pa.list_(pa.int64() if f < 2 else pa.binary())) for f in range(3)]
                    own = pa.array(which)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(target, pa.int64()), batch.column(0).take(own), batch.column(3).take(own), pa.array([x[0] for x in low], pa.int64()), pa.array(data, pa.binary()), *fields],
                        names=["target", "doc_id", "row", "low", "words", "at", "until", "around"],
                    )

    lists = "at array<long>, until array<long>, around array<binary>"
    return joined.select("doc_id", "text", "anchors", row).mapInArrow(cut, f"target long, doc_id {kind}, row long, low long, words binary, {lists}")


_GROUP = pa.struct([("n_words", pa.int64()), ("last", pa.int64())])
_COLUMNS = ["repeat", "rank", "n_words", "doc_id", "start", "groups", "row"]


def tree(p: Params):
    """From the pieces of a partition, anchor after anchor, the rows of ``find_repeats``; one anchor's pieces are held at a time."""

    def of_anchor(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        table = pa.Table.from_batches(batches).combine_chunks()
        sizes = pc.list_value_length(table["at"]).to_numpy()
        text = np.repeat(np.arange(len(sizes)), sizes)
        at, until = (table[c].combine_chunks().flatten().to_numpy() for c in ("at", "until"))
        if len(at) < 2:
            return
        # in an order that doesn't depend on the shuffle's
        order = np.lexsort((at, table["low"].to_numpy()[text], table["row"].to_numpy()[text]))
        text, at, until = text[order], at[order], until[order]
        around = [x.as_py() for x in table["around"].combine_chunks().flatten().take(pa.array(order))]
        texts = [np.frombuffer(w.as_buffer(), ">u4") for w in table["words"]]
        base = table["low"].to_numpy()[text]
        for own, depth, groups in repeats_at(texts, text, at - base, np.zeros(len(text), np.int64), until - base, around, p):
            which = pa.array(text[own])
            yield table["doc_id"].combine_chunks().take(which), table["row"].to_numpy()[text[own]], at[own] - depth, groups

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        out: list = []

        def flush() -> pa.RecordBatch:
            n = [len(o[1]) for o in out]
            first = np.concatenate([np.sort(np.array([a for _, a, _ in o[3]], np.int64)) + k for o, k in zip(out, np.cumsum(n) - n)])
            listed = [g for o in out for g in sorted(o[3], key=lambda g: (g[1], g[0]))]
            offsets = np.searchsorted(first, np.arange(sum(n) + 1)).astype(np.int32)
            groups = pa.ListArray.from_arrays(pa.array(offsets), pa.array([{"n_words": k, "last": b} for k, _, b in listed], _GROUP))
            columns = [
                np.repeat([number + i for i in range(len(out))], n), np.concatenate([np.arange(k) for k in n]), np.repeat([o[3][0][0] for o in out], n),
                pa.concat_arrays([o[0] for o in out]), np.concatenate([o[2] for o in out]), groups, np.concatenate([o[1] for o in out]),
            ]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names=_COLUMNS)

        held = 0
        for part in common.by_key(batches):
            for found in of_anchor(part):
                out.append(found)
                held += len(found[1]) + len(found[3])
                if held > 50_000:
                    yield flush()
                    number, held = number + len(out), 0
                    out.clear()
        if out:
            yield flush()

    return run


def find_repeats(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """repeat, rank, n_words, doc_id, start and groups, as the module's text says."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"repeat long, rank long, n_words long, doc_id {kind}, start long, groups array<struct<n_words: long, last: long>>, row long"
    rows, row = common.with_row_id(common.fixed(docs.select("doc_id", "text")))
    others = common.saved(copies(rows, row), "copies")
    cut = pieces(rows, row, others, params).repartition(common.partitions(docs.sparkSession) * 4, "target").sortWithinPartitions("target")
    found = common.saved(cut.mapInArrow(tree(params), schema), "repeats")
    again = found.drop("doc_id").join(others, F.col("row") == F.col("head")).withColumn("groups", F.lit(None).cast(found.schema["groups"].dataType))
    return found.select(_COLUMNS[:-1]).union(again.select(_COLUMNS[:-1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_repeats(common.table(spark, sf_dir, "documents"))
