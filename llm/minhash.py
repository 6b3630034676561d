"""MinHash near-duplicate groups by an inverted join over signature coordinates.

1. A signature of ``coordinates`` minima is taken over the hashed word ``shingle``-grams
   of each whole text. Rows of equal signatures become one node at once.
2. *Posting with a prefix.* Two nodes that agree in at least ``matches`` of K coordinates
   share a (coordinate, value) within the first K - matches + 1 of either's pairs, in any
   order that is the same for all nodes. Pairs are ordered by how many nodes hold them
   (rarest first, counted over all nodes), so a passage that many documents share costs
   nothing unless it makes up most of a document. Only those prefixes are posted.
3. *Counting with skips.* Within a posting list a node is compared with all that aren't
   yet in its group: the equal coordinates are counted, and those at or above ``matches``
   join its group. Members that are grouped already are skipped, so a list of thousands of
   copies takes few passes. Of lists with the same members one is counted.
4. Links between nodes are closed to groups by alternating large and small stars.

What counts as near is a Jaccard similarity of 0.6 of the word ``shingle``-grams: there 32 of
64 coordinates agree with probability 0.96 (0.82 at 0.55, 0.08 at 0.4).

No list, candidate or partner is capped. Every step but the bounded pair counts (a fixed
array of hashed counters, used for the order alone) is a distributed table; groups are
summed before the shuffle and joined back, never gathered in one row or window.

One row is one document: group_id and group_size, n_links (how many other texts the merging
linked its own to; members that were grouped already are skipped, not linked again),
n_copies (documents of the same signature) and kept.

Defined results for odd input: a text without a word (null, empty, punctuation only) is
never anyone's copy; a text of fewer words than a shingle has its word sequence as its one
shingle; rows without doc_id, and rows that repeat a doc_id, count as documents of their
own; of each group the least doc_id stays (null last, then the first row); texts of any
length are read whole; an empty table gives an empty result; columns besides doc_id and
text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .kernel import Words, mix, ngrams, slices


@dataclass(frozen=True)
class Params:
    coordinates: int = 64
    matches: int = 32
    shingle: int = 3
    seed: int = 1
    counters: int = 1 << 20


def _family(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    draw = lambda: rng.integers(0, 1 << 32, p.coordinates, dtype=np.uint64).astype(np.uint32)
    return draw() | np.uint32(1), draw()


def signatures(column: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """The uint32 signature of each row, and which rows have any word."""
    scale, shift = _family(p)
    out = np.zeros((len(column), p.coordinates), np.uint32)
    has = np.zeros(len(column), bool)
    for at, part in slices(column):
        words = Words(part)
        counts = np.diff(words.first)
        has[at : at + words.n] = counts > 0
        grams, position = ngrams(words, p.shingle)
        row = words.row()[position]
        short = np.flatnonzero((counts > 0) & (counts < p.shingle))
        if len(short):
            whole = np.array([np.bitwise_xor.reduce(mix(words.hash[words.first[i] : words.first[i + 1]] + np.arange(counts[i], dtype=np.uint64))) for i in short], np.uint64)
            grams, row = np.concatenate([grams, whole]), np.concatenate([row, short])
            order = np.argsort(row, kind="stable")
            grams, row = grams[order], row[order]
        if not len(grams):
            continue
        x = (grams >> np.uint64(32)).astype(np.uint32)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        for k in range(p.coordinates):
            out[at + row[first], k] = np.minimum.reduceat(x * scale[k] + shift[k], first)
    return out, has


def pair_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each (coordinate, value)."""
    return mix(signature.astype(np.uint64) + (np.arange(signature.shape[1], dtype=np.uint64)[None, :] << np.uint64(32)))


def _matrix(column: pa.Array, p: Params) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), p.coordinates)


#: Members of a list from which on those that can link to no other are taken out first.
LONG = 256


def _common(signature: np.ndarray, matches: int) -> np.ndarray:
    """The rows that agree with others, whichever these are, in ``matches`` coordinates or more; again among them, until all do."""
    own = np.arange(len(signature))
    while True:
        shared = np.zeros(len(own), np.int64)
        for column in signature[own].T:
            order = np.argsort(column, kind="stable")
            same = column[order[1:]] == column[order[:-1]]
            shared[order[1:][same]] += 1
            shared[order[:-1][same & ~np.append(False, same[:-1])]] += 1  # a run's first
        keep = shared >= matches
        if keep.all():
            return own
        own = own[keep]


def linked(row: np.ndarray, signature: np.ndarray, matches: int) -> Iterator[tuple[np.ndarray, int]]:
    """Groups of the rows that agree in ``matches`` coordinates or are joined by such links: (members, least member)."""
    left = np.arange(len(row)) if len(row) < LONG else _common(signature, matches)
    while len(left) > 1:
        group, border, left = [left[0]], [left[0]], left[1:]
        while border and len(left):
            close = (signature[left] == signature[border.pop()]).sum(1) >= matches
            group += left[close].tolist()
            border += left[close].tolist()
            left = left[~close]
        if len(group) > 1:
            members = row[group]
            yield members, int(members.min())


def _stars(edges: DataFrame) -> DataFrame:
    """(node, root) for edges (u, v): alternating large and small stars until nothing changes."""
    state = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = common.saved(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = common.saved(small, "stars")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("h")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def groups(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """Each row's group: __row (as ``common.with_row_id`` gives it), doc_id, group_id, group_size, n_links, n_copies, kept."""
    p = params
    docs, row = common.with_row_id(common.fixed(docs.select("doc_id", "text")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature, has = signatures(batch.column(2), p)
            data = pa.array([s.tobytes() if h else None for s, h in zip(signature, has)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data], names=["row", "doc_id", "signature"])

    signed = common.saved(docs.select(row, "doc_id", "text").mapInArrow(sign, f"row long, doc_id {kind}, signature binary"), "signatures")
    keyed = signed.where("signature IS NOT NULL").select("row", "doc_id", F.xxhash64("signature").alias("h"), F.xxhash64(F.lit(1), "signature").alias("g"))
    first = keyed.groupBy("h", "g").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("n_copies"))
    alone = signed.where("signature IS NULL").select("row", "doc_id", F.col("row").alias("node"), F.lit(1).cast("long").alias("n_copies"))
    nodes = common.saved(keyed.join(first, ["h", "g"]).select("row", "doc_id", "node", "n_copies").union(alone), "nodes")
    heads = signed.where("signature IS NOT NULL").join(nodes.where("row = node").select("node"), F.col("row") == F.col("node")).select("node", "signature")
    heads = common.saved(heads, "heads")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(p.counters, np.int64)
        for batch in batches:
            if batch.num_rows:
                held += np.bincount((pair_keys(_matrix(batch.column(0), p)).ravel() % np.uint64(p.counters)).astype(np.int64), minlength=p.counters)
        yield from common.count_rows(held)

    held = common.gathered(common.summed(heads.select("signature").mapInArrow(count, common.COUNTS_SCHEMA)).collect(), p.counters)
    shared = docs.sparkSession.sparkContext.broadcast(held.astype(np.uint32))  # of fixed size

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = p.coordinates - p.matches + 1
        for batch in batches:
            if batch.num_rows:
                keys = pair_keys(_matrix(batch.column(1), p))
                order = np.lexsort((keys, shared.value[(keys % np.uint64(p.counters)).astype(np.int64)]), axis=1)[:, :width]
                keys = np.take_along_axis(keys, order, 1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), width))], names=["key", "node"])

    posted = heads.mapInArrow(post, "key long, node long")
    # lists are told apart by their size and two sums of hashes, so that none is gathered in a row
    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    lists = lists.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    members = posted.join(lists.hint("shuffle_hash"), "key").join(heads.hint("shuffle_hash"), "node").select(F.col("key").alias("list"), "node", "signature")
    members = members.repartition(common.partitions(docs.sparkSession), "list").sortWithinPartitions("list", "node")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list = []
        v: list = []
        for part in common.by_key(batches):
            own = pa.Table.from_batches(part).combine_chunks()
            for grouped, least in linked(own["node"].to_numpy(), _matrix(own["signature"].combine_chunks(), p), p.matches):
                u += [m for m in grouped.tolist() if m != least]
                v += [least] * (len(grouped) - 1)
            if len(u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    edges = common.saved(members.mapInArrow(merge, "u long, v long").distinct(), "links")
    links = edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    joined = nodes.join(_stars(edges), "node", "left").join(links, "node", "left")
    joined = common.saved(joined.select("row", "doc_id", "n_copies", F.coalesce("root", "node").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "members")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    sums = joined.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    out = joined.join(sums, "root")
    return out.select(F.col("row").alias("__row"), "doc_id", F.col("first.doc_id").alias("group_id"), "group_size", "n_links", "n_copies", (F.col("first.row") == F.col("row")).alias("kept"))


def deduplicate(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """One row of ``docs`` of each group of near-duplicates, all columns as they are.

    The texts are shuffled once, hashed by row, against the rows to drop.
    """
    docs = common.fixed(docs)
    dropped = groups(docs, params).where("NOT kept").select("__row")
    rows, name = common.with_row_id(docs)
    dropped = dropped.withColumnRenamed("__row", name)
    return rows.join(dropped.hint("shuffle_hash"), name, "left_anti").drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.table(spark, sf_dir, "documents")).drop("__row")
