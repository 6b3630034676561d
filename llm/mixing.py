"""Mixing sources to target weights in blocks of tokens.

1. *Packing.* Each source's token ids, an end-of-document id after each document, run on
   through fixed blocks of ``block_tokens`` ids in the order of the scan. What a task has left
   of a source when it ends is joined with the other tasks' remainders, ``FAN`` at a time, and
   these run on through blocks likewise; so at most one block of each source is shorter
   (``n_tokens``), and nothing is dropped. A source's blocks are numbered 0 .. B-1 by task,
   then in order.
2. *Drawing.* For each output shard of ``shard_blocks`` slots, how many come from which
   source is one multinomial draw at the target weights, seeded by the shard.
3. *Mapping.* The r-th slot of a source over all shards takes its block perm(r mod B), where
   perm is a keyed Feistel permutation of 0 .. B-1, another one for each epoch r div B: a
   source's blocks are all used once before any is used again. A permutation of the
   shard's slots mixes the sources within it.
4. *Joining.* Slots and blocks are joined by (source, index): first the index with the ranges
   of indices that tasks have, then with the blocks. Only totals by source come to the driver.

As many slots are filled as there are blocks. Target weights are a parameter; without,
they are the sources' shares of blocks to the power ``temper``, scaled to one.

Defined results for odd input: a null source is a source of its own; sources without
weight get none, weights of absent sources are left out and the rest scaled to one; a
null or empty text has no tokens and adds nothing; a text of any length runs through as many
blocks as it needs; rows without doc_id and repeated rows are packed as any other; an empty
table, or weights that leave no source, give an empty result; columns besides doc_id, text
and source are not read, and ``mix_documents`` passes them on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens
from .kernel import mix, slices

_U = np.uint64
#: Tasks, or groups of tasks, whose remainders are joined at a time.
FAN = 1024


@dataclass(frozen=True)
class Params:
    block_tokens: int = 1024
    shard_blocks: int = 4096
    weights: dict | None = field(default=None)
    temper: float = 0.7
    seed: int = 11
    vocabulary: str = tokens.VOCABULARY


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """x's image under a keyed permutation of 0 .. n-1, elementwise: a four-round Feistel net, walked until within n."""
    x, n, key = x.astype(_U), n.astype(_U), key.astype(_U)
    half = np.ones(len(x), _U)
    while (grow := (_U(1) << (half * _U(2))) < n).any():
        half[grow] += _U(1)
    mask = (_U(1) << half) - _U(1)
    out, left = x.copy(), np.arange(len(x))
    while len(left):
        a, b, m, k = out[left] >> half[left], out[left] & mask[left], mask[left], key[left]
        for i in range(4):
            a, b = b, a ^ (mix(b ^ mix(k + _U(i))) & m)
        out[left] = (a << half[left]) | b
        left = left[out[left] >= n[left]]
    return out.astype(np.int64)


def draw(shard: int, size: int, weights: np.ndarray, seed: int) -> np.ndarray:
    """The slots of each source in one shard."""
    return np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(size, weights)


def _targets(blocks: list, p: Params) -> dict:
    """source -> weight, of sources that have blocks; blocks: (source, number)."""
    if p.weights is None:
        total = sum(n for _, n in blocks) or 1
        raw = {s: (n / total) ** p.temper for s, n in blocks}
    else:
        raw = {s: float(p.weights.get(s, 0)) for s, _ in blocks}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items() if w > 0} if total > 0 else {}


def _slots(counts_of: DataFrame, p: Params) -> DataFrame:
    """shard, slot, source, epoch, index, task and nth of each output slot; counts_of: source, task, blocks (one row each)."""
    spark = counts_of.sparkSession
    # as many rows as there are sources
    have = {r["source"]: (r["blocks"], r["tasks"]) for r in counts_of.groupBy("source").agg(F.sum("blocks").alias("blocks"), F.count(F.lit(1)).alias("tasks")).collect()}
    targets = _targets([(s, n) for s, (n, _) in have.items()], p)
    names = sorted(targets, key=lambda s: (s is not None, s or ""))
    size = np.array([have[s][0] for s in names], np.int64)
    step = np.array([max(1, have[s][0] // have[s][1]) for s in names], np.int64)  # a task's blocks on average
    weights = np.array([targets[s] for s in names])
    total = sum(n for n, _ in have.values()) if names else 0
    n_shards = -(-total // p.shard_blocks)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                of = draw(shard, min(p.shard_blocks, total - shard * p.shard_blocks), weights, p.seed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(of), pa.int64()), pa.array(np.arange(len(of), dtype=np.int32)), pa.array(of.astype(np.int64)), pa.array(np.cumsum(of) - of)], names=["shard", "s", "n", "before"]
                )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, s, n, before, rank = (c.to_numpy() for c in batch.columns)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shard, s, rank, slot = np.repeat(shard, n), np.repeat(s, n), np.repeat(rank, n) + k, np.repeat(before, n) + k
            epoch = rank // size[s]
            index = permuted(rank % size[s], size[s], mix(_U(p.seed) + (s.astype(_U) << _U(40)) + epoch.astype(_U)))
            slot = permuted(slot, np.minimum(p.shard_blocks, total - shard * p.shard_blocks), mix(_U(p.seed + 1) + (shard.astype(_U) << _U(32))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, slot, s, epoch, index, index // step[s])], names=["shard", "slot", "s", "epoch", "index", "range"])

    drawn = spark.range(0, n_shards, 1, max(1, min(n_shards, common.partitions(spark)))).mapInArrow(counts, "shard long, s int, n long, before long").where("n > 0")
    rank = F.sum("n").over(Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    ranked = drawn.withColumn("rank", F.coalesce(rank, F.lit(0)))
    slots = ranked.select("shard", "s", "n", "before", "rank").mapInArrow(spread, "shard long, slot long, s int, epoch long, index long, range long")
    named = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(zip(names, step.tolist()))], "s int, source string, step long")
    before = F.sum("blocks").over(Window.partitionBy("s").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    same = F.col("source").eqNullSafe(F.col("of"))
    bases = counts_of.withColumnRenamed("source", "of").join(F.broadcast(named), same).withColumn("base", F.coalesce(before, F.lit(0)))
    # a task's blocks lie in as many ranges of ``step`` indices as they touch: about one
    spans = F.explode(F.sequence(F.floor(F.col("base") / F.col("step")), F.floor((F.col("base") + F.col("blocks") - 1) / F.col("step"))))
    bases = bases.select("s", "source", "task", "base", "blocks", spans.alias("range"))
    placed = slots.join(bases.hint("shuffle_hash"), ["s", "range"])  # unhinted, the slots might be taken for as few as their shards, and broadcast.where("index >= base AND index < base + blocks")
    return placed.select("shard", "slot", "source", "epoch", "index", "task", (F.col("index") - F.col("base")).alias("nth"))


def _stretches(bounds: np.ndarray, names: list, filled: dict, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, nth block of its source, first, end) of each row's stretches; an end-of-document id counts as the row's last."""
    for i, name in enumerate(names):
        n = int(bounds[i + 1] - bounds[i])
        if n:
            at, start = 0, filled.get(name, 0)
            filled[name] = start + n + 1
            while at < n + 1:
                block = (start + at) // size
                end = min(n + 1, (block + 1) * size - start)
                yield i, block, at, end
                at = end


def _joined(packed: DataFrame, key: str, merge) -> DataFrame:
    """``packed`` (task, key, nth, full, at, ...) with the remainders (``full`` false) run on through blocks of their own.

    Remainders of ``FAN`` tasks, then of as many groups of tasks, and so on, go through
    ``merge(level)`` in order, until there is one of each source.
    """
    done, rest, level = [packed.where("full")], packed.where("NOT full"), 0
    last = packed.agg(F.max("task")).first()[0] or 0
    while True:
        level += 1
        grouped = rest.withColumn("group", F.floor(F.col("task") / FAN) if level == 1 else F.floor(F.col("task") % (1 << 40) / FAN))
        grouped = grouped.select(F.xxhash64(F.coalesce(key, F.lit("")), F.col(key).isNull(), "group").alias("k"), "group", *[c for c in packed.columns if c not in ("nth", "full")])
        grouped = grouped.repartition(common.partitions(packed.sparkSession), "k").sortWithinPartitions("k", "group", key, "task", "at")
        merged = common.saved(grouped.mapInArrow(merge(level), packed.schema), "remainders")
        last //= FAN
        if not last:
            return common.union([*done, merged])
        done.append(merged.where("full"))
        rest = merged.where("NOT full")


def _blocks(docs: DataFrame, p: Params) -> DataFrame:
    """task, source, nth, full, at, n_tokens, doc_ids, sizes (ids of each document in the block) and ids of each block."""
    names_out = ["task", "source", "nth", "full", "at", "n_tokens", "doc_ids", "sizes", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder = tokens.tokenizer(p.vocabulary)
        width = np.uint16 if encoder.size < 1 << 16 else np.uint32
        filled: dict = {}
        open_blocks: dict = {}
        id_type = pa.int64()

        def rows(done: list) -> pa.RecordBatch:
            ids = [np.concatenate(b[2]) for b in done]
            n, none = len(done), pa.array([0] * len(done), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([task] * n, pa.int64()), pa.array([b[0][0] for b in done], pa.string()), pa.array([b[0][1] for b in done], pa.int64()), pa.array([len(x) == p.block_tokens for x in ids], pa.bool_()), none,
                 pa.array([len(x) for x in ids], pa.int64()), pa.array([b[1] for b in done], pa.list_(id_type)), pa.array([b[3] for b in done], pa.list_(pa.int32())), pa.array([x.tobytes() for x in ids], pa.binary())],
                names=names_out,
            )

        for batch in batches:
            id_type = batch.column(0).type
            for first, column in slices(batch.column(2)):
                ids, bounds = encoder.encode(column)
                keys, names = (batch.column(k).slice(first, len(column)).to_pylist() for k in (0, 1))
                done = []
                for i, nth, at, end in _stretches(bounds, names, filled, p.block_tokens):
                    key, docs_in, parts, sizes = open_blocks.setdefault(names[i], ((names[i], nth), [], [], []))
                    docs_in.append(keys[i])
                    sizes.append(end - at)
                    n = int(bounds[i + 1] - bounds[i])
                    parts.append(ids[bounds[i] + at : bounds[i] + min(end, n)].astype(width))
                    if end > n:
                        parts.append(np.array([encoder.size], width))
                    if sum(sizes) == p.block_tokens:
                        done.append(open_blocks.pop(names[i]))
                if done:
                    yield rows(done)
        if open_blocks:
            yield rows(list(open_blocks.values()))

    def merge(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in common.by_key(batches):
                rows = pa.Table.from_batches(part).combine_chunks()
                source, group = rows["source"][0].as_py(), rows["group"][0].as_py()
                ids_in = rows["doc_ids"].combine_chunks().flatten()
                sizes = rows["sizes"].combine_chunks().flatten().to_numpy()
                ids = b"".join(rows["ids"].to_pylist())
                width = len(ids) // int(sizes.sum())
                ends = np.cumsum(sizes)
                cuts = np.append(np.arange(0, ends[-1], p.block_tokens), ends[-1])
                lo, hi = np.searchsorted(ends, cuts[:-1], side="right"), np.searchsorted(ends, cuts[1:]) + 1
                own = [np.minimum(ends[a:b], y) - np.maximum(ends[a:b] - sizes[a:b], x) for a, b, x, y in zip(lo, hi, cuts, cuts[1:])]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(level << 40) + group] * n, pa.int64()), pa.array([source] * n, pa.string()), pa.array(np.arange(n)), pa.array(np.diff(cuts) == p.block_tokens), pa.array(np.zeros(n, np.int64)), pa.array(np.diff(cuts)),
                     pa.array([ids_in.slice(a, b - a).to_pylist() for a, b in zip(lo, hi)], pa.list_(ids_in.type)), pa.array([x.tolist() for x in own], pa.list_(pa.int32())), pa.array([ids[x * width : y * width] for x, y in zip(cuts, cuts[1:])], pa.binary())],
                    names=names_out,
                )

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = F.col("source").cast("string")
    packed = docs.select("doc_id", source, "text").mapInArrow(run, f"task long, source string, nth long, full boolean, at long, n_tokens long, doc_ids array<{kind}>, sizes array<int>, ids binary")
    return _joined(common.saved(packed, "blocks"), "source", merge)


def _whole(data: bytes, stop: int) -> int:
    """The first place from ``stop`` on that no character goes across."""
    while stop < len(data) and data[stop] & 0xC0 == 0x80:
        stop += 1
    return stop


def _pieces(docs: DataFrame, p: Params) -> DataFrame:
    """task, key, nth, full and the stretch of ``docs`` (its other columns, the stretch as text) of each piece of each block.

    Of a remainder's pieces, at is their order, lengths the bytes of each of their tokens, and skip how many of these
    bytes the piece before has, as it ends with a whole character.
    """
    rest = [c for c in docs.columns if c != "text"]
    row = docs.select(F.col("source").cast("string").alias("key"), F.col("text").alias("body"), F.struct(*rest).alias("rest"))
    names_out = ["task", "key", "nth", "full", "at", "body", "lengths", "skip", "rest"]

    def batch_of(task: int, key: list, nth: list, full: bool | list, body: list, lengths: list, skip: list, rest: pa.Array) -> pa.RecordBatch:
        n = len(nth)
        columns = [pa.array([task] * n, pa.int64()), pa.array(key, pa.string()), pa.array(nth, pa.int64()), pa.array([full] * n if isinstance(full, bool) else full, pa.bool_()), pa.array(np.arange(n)), pa.array(body, pa.string())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(lengths, pa.binary()), pa.array(skip, pa.int64()), rest], names=names_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder = tokens.tokenizer(p.vocabulary)
        filled: dict = {}
        pending: dict = {}  # the open block of each source: its pieces
        for batch in batches:
            for own in pending.values():  # what they have of the batch before
                own[:] = [x if isinstance(x[-1], pa.Array) else (*x[:-1], last.slice(x[-1], 1)) for x in own]
            last = batch.column(2)
            for first, column in slices(batch.column(1)):
                ids, bounds = encoder.encode(column)
                size = encoder.lengths[ids]
                to = np.concatenate([[0], np.cumsum(size)])
                names, texts = batch.column(0).slice(first, len(column)).to_pylist(), column.to_pylist()
                done: list = []
                at_row, data, cut = -1, b"", 0
                for i, nth, at, end in _stretches(bounds, names, filled, p.block_tokens):
                    if i != at_row:
                        at_row, data, cut = i, texts[i].encode(), 0
                    begin, inside = int(to[bounds[i] + at] - to[bounds[i]]), min(end, int(bounds[i + 1] - bounds[i]))
                    stop = max(cut, _whole(data, int(to[bounds[i] + inside] - to[bounds[i]])))
                    own = pending.setdefault(names[i], [])
                    own.append((names[i], nth, data[cut:stop].decode(), size[bounds[i] + at : bounds[i] + inside], end - at, cut - begin, first + i))
                    cut = stop
                    if sum(x[4] for x in own) == p.block_tokens:
                        done += pending.pop(names[i])
                done = [x for x in done if x[2]]
                if done:
                    older = [x for x in done if isinstance(x[-1], pa.Array)]
                    newer = [x for x in done if not isinstance(x[-1], pa.Array)]
                    parts = [x[-1] for x in older] + [batch.column(2).take(pa.array([x[-1] for x in newer], pa.int64()))]
                    both = older + newer
                    yield batch_of(task, [x[0] for x in both], [x[1] for x in both], True, [x[2] for x in both], [None] * len(both), [0] * len(both), pa.concat_arrays(parts))
        left = [x if isinstance(x[-1], pa.Array) else (*x[:-1], last.slice(x[-1], 1)) for own in pending.values() for x in own]
        if left:
            # an end-of-document id is a token of no bytes
            lengths = [np.append(x[3], [0] * (x[4] - len(x[3]))).astype(np.uint32).tobytes() for x in left]
            yield batch_of(task, [x[0] for x in left], [x[1] for x in left], False, [x[2] for x in left], lengths, [x[5] for x in left], pa.concat_arrays([x[-1] for x in left]))

    def merge(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in common.by_key(batches):
                rows = pa.Table.from_batches(part).combine_chunks()
                key, group = rows["key"][0].as_py(), rows["group"][0].as_py()
                lengths = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["lengths"].to_pylist()]
                total = sum(map(len, lengths))
                out, filled = [], 0
                for i, (size, body, skip) in enumerate(zip(lengths, rows["body"].to_pylist(), rows["skip"].to_pylist())):
                    data, to, at, cut = body.encode(), np.concatenate([[0], np.cumsum(size)]) - skip, 0, 0
                    while at < len(size):
                        nth = filled // p.block_tokens
                        end = min(len(size), at + (nth + 1) * p.block_tokens - filled)
                        stop = max(cut, _whole(data, min(len(data), max(0, int(to[end])))))
                        full = (nth + 1) * p.block_tokens <= total
                        out.append((nth, full, data[cut:stop].decode(), None if full else size[at:end].astype(np.uint32).tobytes(), cut - int(to[at]), i))
                        filled, at, cut = filled + end - at, end, stop
                out = [x for x in out if x[2] or not x[1]]
                if out:
                    nth, full, body, own, skip, at = zip(*out)
                    yield batch_of((level << 40) + group, [key] * len(out), list(nth), list(full), list(body), list(own), list(skip), rows["rest"].combine_chunks().take(pa.array(at)))

        return run

    kind = row.schema["rest"].dataType.simpleString()
    packed = row.mapInArrow(run, f"task long, key string, nth long, full boolean, at long, body string, lengths binary, skip long, rest {kind}")
    return _joined(common.saved(packed, "pieces"), "key", merge).where("body <> ''")


def _numbers(packed: DataFrame, source: str) -> DataFrame:
    """source, task, blocks: as many rows as there are input splits and sources."""
    return common.saved(packed.groupBy(F.col(source).alias("source"), "task").agg((F.max("nth") + 1).alias("blocks")), "numbers")


def mix_blocks(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """shard, slot, source, epoch, index, n_tokens, doc_ids and ids (uint16 or, of large vocabularies, uint32, little-endian)."""
    blocks = _blocks(docs, params)
    slots = _slots(_numbers(blocks, "source"), params)
    b = blocks.withColumnRenamed("source", "key")
    same = F.col("source").eqNullSafe(F.col("key")) & (slots["task"] == b["task"]) & (slots["nth"] == b["nth"])
    return slots.hint("shuffle_hash").join(b, same).select("shard", "slot", "source", "epoch", "index", "n_tokens", "doc_ids", "ids")


def mix_documents(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The mixture as rows of the columns of ``docs``: each is a document's stretch within a drawn block.

    A block that is drawn more than once gives its rows as often. A document whose stretches
    lie in several blocks has several rows; n_chars, where there is such a column, is the
    stretch's own.
    """
    pieces = _pieces(docs, params)
    slots = _slots(_numbers(pieces, "key"), params).select("source", "task", "nth")
    same = F.col("source").eqNullSafe(F.col("key")) & (slots["task"] == pieces["task"]) & (slots["nth"] == pieces["nth"])
    drawn = slots.hint("shuffle_hash").join(pieces, same)
    own = {"text": F.col("body"), "n_chars": F.length("body").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return drawn.select(*[(own[c] if c in own else F.col("rest")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_blocks(common.table(spark, sf_dir, "documents"))
