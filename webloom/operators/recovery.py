"""What becomes of a response: status guard, kinds, and the choice among recovery candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions import text

ROUTES = ("impersonate", "jina", "wayback")
SILENT = ("ConnectTimeout", "ReadTimeout", "WriteTimeout", "PoolTimeout", "ConnectError", "ReadError", "WriteError", "CloseError", "NetworkError")


def usable(status: Column) -> Column:
    """Whether a status can carry content: 200 to 299."""
    return F.coalesce(status.between(200, 299), F.lit(False))


def kind(status: Column, content_type: Column, follow_pdf: bool = True) -> Column:
    """error, skipped, html or pdf."""
    told = text.classify(content_type)
    told = told if follow_pdf else F.when(told == "pdf", "skipped").otherwise(told)
    return F.when(~usable(status), "error").otherwise(told)


def routes(value: str) -> list[str]:
    """The known routes of a comma-separated list, in its order."""
    return [r for r in (x.strip().lower() for x in value.split(",")) if r in ROUTES]


def is_silence(error: Column) -> Column:
    return F.coalesce(error.isin(*SILENT), F.lit(False))


def best_candidate(candidates: DataFrame, least_chars: int, key: str = "url") -> DataFrame:
    """Of the rows (key, route, route_pos, body, content_type, via) of a page: the first with enough visible text, else the fullest (ties: the first)."""
    chars = F.length(text.visible_text(F.col("body")))
    is_pdf = text.classify(F.col("content_type")) == "pdf"
    row = F.struct("route", "route_pos", "body", "content_type", "via", "chars")
    sized = candidates.where(F.length("body") > 0).withColumn("chars", chars).withColumn("__ok", (F.lit(least_chars) <= 0) | is_pdf | (F.col("chars") >= least_chars))
    first = F.min(F.when(F.col("__ok"), F.struct("route_pos", row.alias("row"))))
    fullest = F.max_by(row, F.struct("chars", -F.col("route_pos")))
    return sized.groupBy(key).agg(F.coalesce(first["row"], fullest).alias("best")).select(key, "best.*")


def newest_capture(captures: DataFrame, max_age_days: int = 0, key: str = "url", now: Column | None = None) -> DataFrame:
    """The latest capture with status 200 of each URL, unless it is too old."""
    best = captures.where("status = 200").groupBy(key).agg(F.max_by(F.struct("stamp", "body", "content_type"), "stamp").alias("c"))
    return best.select(key, "c.*").where(~text.too_old(F.col("stamp"), max_age_days, now)).withColumn("via", F.concat(F.lit("wayback:"), F.col("stamp")))
