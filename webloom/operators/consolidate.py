"""Consolidation: ordered concatenation of the matched pages and the fit into a token budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import tokens
from webloom.operators.cache import ParquetStore, replay
from webloom.providers.base import Provider
from webloom.session import saved

MOST_LEVELS = 5
JOIN = "\n\n"


def source_part() -> Column:
    """A page under a line that names its source."""
    return F.concat(F.lit("--- SOURCE: "), F.col("url"), F.lit("\n"), F.col("md"))


def concatenated(pages: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One text per group of pages(canon, url, md): each under a line that names its source, in the order of canonical URLs."""
    ordered = F.array_sort(F.collect_list(F.struct("canon", source_part().alias("part"))))
    return pages.groupBy(*(group or [])).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), JOIN).alias("text"))


@dataclass(frozen=True)
class Fitted:
    text: str
    summarized: bool
    content_tokens: int
    input_tokens: int
    levels: int
    usage: tuple = ()  # rows of usage.COUNTERS and model


@dataclass(frozen=True)
class Fit:
    """What fitting depends on besides the pages."""

    provider: Provider
    criterion: str
    most: int
    always: bool = False
    outline: str = ""
    model: str = ""
    encoding: str = ""
    store: ParquetStore | None = None
    version: str = ""


def _sized(rows: DataFrame, f: Fit) -> DataFrame:
    """rows(ord, text) with n, the tokens of each and of the blank line after it, as they are in the whole."""
    return saved(rows.withColumn("n", tokens.count_tokens(F.col("text"), f.model, f.encoding, JOIN)), "fit")


def _size(rows: DataFrame, f: Fit) -> int:
    """The tokens of all rows in one: sums on the executors, the last row's without a blank line after it."""
    r = rows.agg(F.sum("n").alias("n"), F.max_by(F.struct("text", "n"), F.struct("ord", "text")).alias("last")).first()
    return r["n"] - r["last"]["n"] + tokens.count(r["last"]["text"], f.model, f.encoding) if r["n"] is not None else 0


def _joined(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return rows.groupBy(*(group or [])).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), JOIN).alias("text"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with ``start``, the tokens of all before them: counted within ranges of the order, plus the sums of the ranges before."""
    ranged = saved(rows.repartitionByRange("ord", "text").withColumn("range", F.spark_partition_id()), "ranges")
    sums = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()}  # as many as there are partitions
    bases, total = [], 0
    for k in sorted(sums):
        bases.append((k, total))
        total += sums[k]
    before = F.sum("n").over(Window.partitionBy("range").orderBy("ord", "text").rowsBetween(Window.unboundedPreceding, -1))
    bases = rows.sparkSession.createDataFrame(bases, "range int, base long")
    return ranged.join(F.broadcast(bases), "range").withColumn("start", F.col("base") + F.coalesce(before, F.lit(0)))


def summarized(rows: DataFrame, key: list[str], f: Fit, used: list) -> DataFrame:
    """key and md: each text cut in chunks of at most ``most`` tokens, these summarised in parallel, or replayed, and joined in order."""
    chunks = rows.select(*key, F.posexplode(tokens.split_by_tokens(max(1, f.most), f.model, f.encoding)(F.col("md"))).alias("i", "c")).select(*key, "i", F.col("c.chunk").alias("__chunk"))
    chunks = chunks.withColumn("cache_key", F.concat(F.lit(f.version + ":"), F.sha2("__chunk", 256)))
    old = replay(chunks, f.store.table(), "summary") if f.store is not None else chunks.withColumn("value", F.lit(None).cast("string"))
    made = old.withColumn("made", f.provider.summarize(F.when(F.col("value").isNull(), F.col("__chunk")), f.criterion, f.outline))
    made = made.select(*key, "i", "cache_key", F.coalesce("value", "made.text").alias("short"), F.when(F.col("value").isNull(), F.col("made.usage")).alias("usage"))
    made = saved(made, "summaries")
    calls = made.where("usage IS NOT NULL").groupBy("usage.model")
    rows_used = calls.agg(*[F.sum(f"usage.{c}").alias(c) for c in ("input_tokens", "output_tokens", "cached_input_tokens")], F.count(F.lit(1)).alias("calls"), F.count_if(F.col("short").isNull()).alias("failed")).collect()
    used += rows_used
    if any(r["failed"] for r in rows_used):
        raise RuntimeError("a summary failed")
    if f.store is not None and rows_used:
        f.store.upsert(made.where("usage IS NOT NULL").select(F.lit("summary").alias("namespace"), F.col("cache_key").alias("key"), F.col("short").alias("value")).distinct())
    ordered = F.array_sort(F.collect_list(F.struct("i", "short")))
    return made.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["short"]), JOIN).alias("md"))


def _rows(pages: DataFrame) -> DataFrame:
    return pages.select(F.struct(F.col("canon").alias("a"), F.lit(0).cast("long").alias("b")).alias("ord"), source_part().alias("text"))


def fit_pages(pages: DataFrame, f: Fit) -> Fitted:
    """The text of pages(canon, url, md) within ``most`` tokens: as it is if it fits; else summarised page by page, then as a
    whole while that shrinks it, then cut.

    Counting, chunking and summaries are tables at every level; a text is put together only when it is known to fit. A chunk of
    the whole is the rows that start within the same ``most`` tokens of it.
    """
    used: list = []
    rows = _sized(_rows(pages), f)
    content = size = _size(rows, f)
    if size <= f.most and not f.always:
        return Fitted(_joined(rows).first()["text"] or "", False, size, size, 0)
    rows, level = _sized(_rows(summarized(pages, ["canon", "url"], f, used)), f), 1
    size = _size(rows, f)
    while size > f.most and level < MOST_LEVELS:
        level += 1
        chunk = F.floor(F.col("start") / max(1, f.most)).alias("chunk")
        whole = _joined(_placed(rows).select("ord", "text", chunk), ["chunk"]).select("chunk", F.col("text").alias("md"))
        short = summarized(whole, ["chunk"], f, used)
        rows = _sized(short.select(F.struct(F.lit("").alias("a"), F.col("chunk").alias("b")).alias("ord"), F.col("md").alias("text")), f)
        before, size = size, _size(rows, f)
        if size >= before:
            break
    if size > f.most:
        text = _joined(_placed(rows).where(F.col("start") < f.most)).first()["text"] or ""
        text = tokens.split(text, f.most, f.model, f.encoding)[0]
        size = tokens.count(text, f.model, f.encoding)
    else:
        text = _joined(rows).first()["text"] or ""
    return Fitted(text, True, content, size, level, tuple(used))
