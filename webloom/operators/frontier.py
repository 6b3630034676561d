"""The best-first frontier as tables: frontier(canon, url, score, seq, source) and known(canon)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .links import first_by


def pop(frontier: DataFrame, n: int) -> DataFrame:
    """The n best: by score, then first come. A top-k of each task and one merge, no full sort."""
    return frontier.orderBy(F.desc("score"), F.asc("seq")).limit(n)


def number(major: Column, minor: Column, after: int = 0) -> Column:
    """Places in an order of two levels, as one number: ``minor`` stays under 2^20, what ``after`` counts (waves) goes before all."""
    return (F.lit(after << 44) + (major.cast("long") * F.lit(1 << 20)) + minor.cast("long")).cast("long")


def push(offers: DataFrame, known: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """The offers (canon, url, score, source, order...) that aren't known, each canonical URL as first offered, numbered on from ``after``.

    Only the order of the numbers counts, so they are made of the order's one or two columns and no row waits for another.
    """
    fresh = first_by(offers.join(known.select("canon"), "canon", "left_anti"), ["canon"], [F.asc(c) for c in order])
    minor = F.col(order[1]) if len(order) > 1 else F.lit(0)
    return fresh.withColumn("seq", number(F.col(order[0]), minor, after)).select("canon", "url", "score", "seq", "source")


def fold(outcomes: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """Outcomes of a wave without those whose landing page was seen, in this wave or before; first in batch order wins."""
    kept = first_by(outcomes, ["canon"], [F.asc("pos")])
    return kept if resolved is None else kept.join(resolved.select("canon"), "canon", "left_anti")
