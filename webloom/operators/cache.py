"""Content-addressed replay: keys, lookup, upsert and the Parquet key-value store."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "screen_match boolean, screen_reason string, link_scores array<struct<url: string, score: double>>"


def version_stamp(*, normalize: bool, model_extract: str, model_screen: str, prompt_signature: str, schema_json: str, criteria: str) -> str:
    """16 hex digits for all that a cached verdict depends on besides the page."""
    parts = [criteria, schema_json, prompt_signature, f"{model_screen}\0{model_extract}", str(int(normalize))]
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:16]


def page_key(version: str, digest: Column, url: Column, prefer_seed: bool = False, direct: bool = False) -> Column:
    prefix = version + (":seeddom" if prefer_seed else "") + (":direct" if direct else "")
    return F.concat(F.lit(prefix + ":"), digest, F.lit(":"), url)


def set_fingerprint(key: Column) -> Column:
    """An aggregate: the digest of a set of keys, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\0"), 256)


def to_value(match: Column, reason: Column, links: Column) -> Column:
    return F.to_json(F.struct(match.alias("screen_match"), reason.alias("screen_reason"), links.alias("link_scores")))


def from_value(value: Column) -> Column:
    """A cached page; a missing reason is empty, missing links are none."""
    v = F.from_json(value, PAGE)
    none = F.from_json(F.lit("[]"), "array<struct<url: string, score: double>>")
    return F.when(
        v["screen_match"].isNotNull(),
        F.struct(v["screen_match"].alias("screen_match"), F.coalesce(v["screen_reason"], F.lit("")).alias("screen_reason"), F.coalesce(v["link_scores"], none).alias("link_scores")),
    )


def replay(rows: DataFrame, kv: DataFrame, namespace: str, key: str = "cache_key") -> DataFrame:
    """Rows with the ``value`` that the store has for their key, or null."""
    own = kv.where(F.col("namespace") == namespace).select(F.col("key").alias(key), "value")
    return rows.join(own, key, "left")


class ParquetStore:
    """A key-value table of (namespace, key, value, seq); later rows win. Any failure to read is a miss, to write is let go."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        schema = "namespace string, key string, value string, seq long"
        try:
            rows = self.spark.read.schema(schema).parquet(self.path)
            rows.schema  # noqa: B018 - is it there?
        except Exception:  # noqa: BLE001
            rows = self.spark.createDataFrame([], schema)
        return rows.groupBy("namespace", "key").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))

    def upsert(self, rows: DataFrame, seq: int | Column | None = None) -> None:
        """Writes rows (namespace, key, value), later than all before unless ``seq`` tells; within one call the greatest value of a key counts."""
        try:
            if not isinstance(seq, Column):
                seq = F.lit(time.time_ns() // 1000 if seq is None else seq)
            rows.select("namespace", "key", "value", seq.cast("long").alias("seq")).write.mode("append").partitionBy("namespace").parquet(self.path)
        except Exception:  # noqa: BLE001
            return
