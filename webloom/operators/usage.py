"""Usage accounting as rows: (function, model, seq, input_tokens, output_tokens, calls, cached_input_tokens)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNTERS = ("input_tokens", "output_tokens", "calls", "cached_input_tokens")


def by_function(events: DataFrame) -> DataFrame:
    """The counters' sums and the last model of each function."""
    return events.groupBy("function").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS], F.max_by("model", "seq").alias("model"))


def delta(start: DataFrame, end: DataFrame) -> DataFrame:
    """What was used between two sums; functions without a call in between fall out."""
    before = start.select("function", *[F.col(c).alias(f"__{c}") for c in COUNTERS])
    joined = end.join(before, "function", "left")
    return joined.select("function", *[(F.col(c) - F.coalesce(F.col(f"__{c}"), F.lit(0))).cast("long").alias(c) for c in COUNTERS], "model").where("calls <> 0")
