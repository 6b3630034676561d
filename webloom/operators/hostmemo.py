"""Which hosts are written off: silent often enough and never heard from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def memo(attempts: DataFrame, key: str, silent: Column, threshold: int) -> DataFrame:
    """key, n_silent, answered, written_off of each host of a log of attempts; a host that answered once stays trusted."""
    out = attempts.groupBy(key).agg(F.count_if(silent).cast("long").alias("n_silent"), F.bool_or(~silent).alias("answered"))
    off = ~F.col("answered") & (F.col("n_silent") >= threshold) if threshold > 0 else F.lit(False)
    return out.withColumn("written_off", off)


def merge(state: DataFrame | None, wave: DataFrame, key: str = "domain") -> DataFrame:
    """The state after another wave: counts added, an answer never forgotten."""
    both = wave if state is None else state.unionByName(wave)
    return both.groupBy(key).agg(F.sum("n_silent").alias("n_silent"), F.bool_or("answered").alias("answered"))
