"""Link edges: extraction, first-wins dedup, the crawl boundary, anti-joins against what is known, scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions import html, text, urls
from webloom.functions.batches import sliced


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def page_links(pages: DataFrame, url: str = "url", body: str = "html", keep: list[str] | None = None) -> DataFrame:
    """keep, pos, anchor, link of every link of every page; a page with a link that can't be resolved has none."""
    found = html.extract_links(F.col(body), F.col(url))
    return pages.select(*(keep or [url]), F.posexplode(found).alias("pos", "__l")).select(*(keep or [url]), "pos", F.col("__l.anchor").alias("anchor"), F.col("__l.url").alias("link"))


def unknown(links: DataFrame, known: DataFrame, link: str = "link") -> DataFrame:
    """Links whose canonical URL isn't in ``known(canon)``."""
    return links.withColumn("canon", urls.canonical(F.col(link))).join(known.select("canon"), "canon", "left_anti")


def within(links: DataFrame, allowed: DataFrame | None, link: str = "link") -> DataFrame:
    """Links whose domain key is in ``allowed(domain)``; all of them if that is None."""
    if allowed is None:
        return links
    keyed = links.withColumn("domain", urls.domain_of(F.col(link)))
    return keyed.join(allowed.select("domain"), "domain", "left_semi").drop("domain")


def blocked_once(links: DataFrame, allowed: DataFrame, link: str = "link") -> DataFrame:
    """The distinct URLs that the boundary refuses, with their key."""
    once = links.select(link).distinct()  # before the keys are made: few URLs, and the readers of the pages have ended
    return once.withColumn("domain", urls.domain_of(F.col(link))).select(link, "domain").join(allowed.select("domain"), "domain", "left_anti")


def aligned_scores(links: DataFrame, scores: DataFrame, page: str) -> DataFrame:
    """Links with the score that was given to their URL on their page: the last one given, within 0 and 1, 0 if none.

    Scores for URLs that weren't asked about fall out.
    """
    last = scores.groupBy(page, "link").agg(F.max_by("score", "score_pos").alias("score"))
    return links.join(last, [page, "link"], "left").withColumn("score", text.clamp(F.col("score")))


def seed_flag(url: Column, seeds: list[str]) -> Column:
    return urls.on_domains(urls.registrable_domain(urls.host(url)), seeds)


def seed_flags(links: Column, seeds: list[str]) -> Column:
    """yes, no or unknown (no domain) of each URL of an array."""

    def told(url: str) -> str:
        try:
            own = urls.registrable(urls.urlsplit(url).hostname)
        except ValueError:
            own = ""
        return "unknown" if not own or not seeds else "yes" if own in seeds else "no"

    @F.arrow_udf("array<string>")
    @sliced
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if own is None else [told(u) for u in own] for own in column.to_pylist()], pa.list_(pa.string()))

    return run(links)
