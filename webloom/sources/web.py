"""The web as tables, and fetching as joins.

web(url, status, content_type, body, error): what each URL answers; error names a transport failure, and a column failed,
if there is one, the address that failed.
redirects(url, resolved), captures(url, stamp, status, body, content_type),
candidates(url, route, route_pos, body, content_type, via), robots(origin, status, content_type, body).
A URL that isn't there answers 404.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import robots as rules
from webloom.functions import text, urls
from webloom.operators import recovery

WEB = "url string, status int, content_type string, body string, error string"
CANDIDATES = "url string, route string, route_pos int, body string, content_type string, via string"


def from_pages(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """A table of stored pages as a web where each answers 200 with HTML."""
    return pages.select(F.col(url).alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.col(body).alias("body"), F.lit(None).cast("string").alias("error"))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    """HTML and PDF files as a web, by Spark's binary file source."""
    files = spark.read.format("binaryFile").load(path)
    kind = F.when(F.lower("path").endswith(".pdf"), "application/pdf").otherwise("text/html")
    body = F.when(F.lower("path").endswith(".pdf"), F.decode("content", "ISO-8859-1")).otherwise(F.decode("content", "UTF-8"))
    return files.select(F.col("path").alias("url"), F.lit(200).alias("status"), kind.alias("content_type"), body.alias("body"), F.lit(None).cast("string").alias("error"))


def policies(robots: DataFrame, escalated: DataFrame | None = None) -> DataFrame:
    """origin, policy: the body of a usable robots.txt, else that of the second transport, else null (all is allowed)."""

    def read(df: DataFrame, name: str) -> DataFrame:
        ok = recovery.usable(F.col("status")) & text.looks_like_policy(F.col("content_type"), F.col("body"))
        return df.select("origin", F.when(ok, F.col("body")).alias(name))

    first = read(robots, "policy")
    if escalated is None:
        return first
    both = first.join(read(escalated, "__second"), "origin", "full")
    return both.select("origin", F.coalesce("policy", "__second").alias("policy"))


def allowed(rows: DataFrame, robots: DataFrame, agent: str, url: str = "url", overrides: list[str] | None = None, name: str = "allow") -> DataFrame:
    """Rows with whether robots.txt lets the agent fetch ``url``; true for no policy and for overridden domains."""
    own = robots.select(F.col("origin").alias("__origin"), F.col("policy").alias("__policy"))
    joined = rows.withColumn("__origin", urls.origin(F.col(url))).join(own, "__origin", "left")
    ok = F.coalesce(rules.can_fetch(agent)(F.col("__policy"), F.col(url)), F.lit(True))
    if overrides:
        ok = ok | urls.domain_of(F.col(url)).isin(*overrides)
    return joined.withColumn(name, ok).drop("__origin", "__policy")


def routed(candidates: DataFrame | None, captures: DataFrame | None, configured: list[str], impersonate: str = "", scope: list[str] | None = None, max_age_days: int = 0) -> DataFrame | None:
    """The candidates of the configured routes alone, in their order; the archive's also from ``captures``. None without any.

    The impersonating route needs a target and keeps to the registrable domains of ``scope``, if that names any.
    """
    parts = []
    if candidates is not None:
        parts.append(candidates.select("url", "route", "body", "content_type", "via"))
    if captures is not None:
        newest = recovery.newest_capture(captures, max_age_days)
        parts.append(newest.select("url", F.lit("wayback").alias("route"), "body", "content_type", "via"))
    if not parts or not configured:
        return None
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    rows = rows.withColumn("route_pos", F.array_position(F.array(*map(F.lit, configured)), F.col("route")).cast("int")).where("route_pos > 0")
    covered = F.lit(bool(impersonate)) & (urls.domain_of(F.col("url")).isin(*scope) if scope else F.lit(True))
    return rows.where((F.col("route") != "impersonate") | covered)


def fetch(
    rows: DataFrame,
    web: DataFrame,
    redirects: DataFrame | None = None,
    candidates: DataFrame | None = None,
    written_off: DataFrame | None = None,
    follow_pdf: bool = True,
    least_chars: int = 200,
    key: str = "url",
) -> DataFrame:
    """rows with resolved, status, content_type, body, kind, via, error, failed (the address that failed), status_given and off (whether its host is written off) of the page that each ``key`` gives.

    What can't carry content is recovered from the best candidate: of the URL asked for after a transport failure,
    of the URL landed on after a bad status. A page of a host that is written off (``written_off(domain)``) is taken
    from a candidate before the origin, which still counts if there is none.
    """
    got = rows
    if redirects is not None:
        got = got.join(redirects.select(F.col("url").alias(key), "resolved"), key, "left").withColumn("resolved", F.coalesce("resolved", key))
    else:
        got = got.withColumn("resolved", F.col(key))
    failed = F.col("failed") if "failed" in web.columns else F.lit(None).cast("string")
    answer = web.select(F.col("url").alias("resolved"), "status", "content_type", "body", "error", failed.alias("failed"))
    got = got.join(answer, "resolved", "left").withColumn("failed", F.when(F.col("error").isNotNull(), F.coalesce(F.nullif("failed", F.lit("")), "resolved"))).withColumn("status", F.when(F.col("error").isNull(), F.coalesce("status", F.lit(404))))
    if written_off is not None:
        off = written_off.select(F.col("domain").alias("__domain"), F.lit(True).alias("__off"))
        got = got.withColumn("__domain", urls.domain_of(F.col(key))).join(off, "__domain", "left").drop("__domain")
    else:
        got = got.withColumn("__off", F.lit(None).cast("boolean"))
    off = F.coalesce("__off", F.lit(False))
    good = recovery.usable(F.col("status"))
    if candidates is not None:
        wanted_pdf = F.lower(F.regexp_replace(F.col("url"), r"[?#].*$", "")).endswith(".pdf")
        usable = candidates if follow_pdf else candidates.where(~wanted_pdf & (text.classify(F.col("content_type")) != "pdf"))
        best = recovery.best_candidate(usable.where(text.classify(F.col("content_type")) != "skipped"), least_chars)
        best = best.select(F.col("url").alias("__asked"), F.struct("body", "content_type", "via").alias("__best"))
        asked = F.when(F.col("error").isNotNull() | off, F.col(key)).otherwise(F.col("resolved"))
        got = got.withColumn("__asked", asked).join(best, "__asked", "left")
    else:
        got = got.withColumn("__asked", F.col(key)).withColumn("__best", F.lit(None).cast("struct<body: string, content_type: string, via: string>"))
    got = got.withColumn("__recovered", F.col("__best").isNotNull() & (off | ~good))
    recovered = F.col("__recovered")
    got = (
        got.withColumn("status_given", F.col("status"))
        .withColumn("__kind", recovery.kind(F.col("status"), F.col("content_type"), follow_pdf))
        .withColumn("kind", F.when(recovered, recovery.kind(F.lit(200), F.col("__best.content_type"), follow_pdf)).otherwise(F.col("__kind")))
        .withColumn("status", F.when(recovered, F.lit(200)).otherwise(F.col("status")))
        .withColumn("body", F.when(recovered, F.col("__best.body")).when(F.col("__kind").isin("error", "skipped"), F.lit("")).otherwise(F.col("body")))
        .withColumn("content_type", F.when(recovered, F.col("__best.content_type")).otherwise(F.col("content_type")))
        .withColumn("via", F.when(recovered, F.col("__best.via")))
        .withColumn("resolved", F.when(recovered, F.col("__asked")).otherwise(F.col("resolved")))
    )
    return got.withColumn("off", off).drop("__off", "__asked", "__best", "__recovered", "__kind")
