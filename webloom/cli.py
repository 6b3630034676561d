"""``python -m webloom.cli extract``: a crawl over stored tables, its result as JSON; exit code 0 on a match, 2 without."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import sys
from pathlib import Path

from pyspark.sql import functions as F

from .plans.crawl import _DEFAULT, Crawler, Web
from .session import get_spark
from .settings import from_environment
from .sources import web


def load_schema(spec: str):
    """``module:Name`` or ``file.py:Name`` of a pydantic model or Spark type; anything else is DDL."""
    place, colon, name = spec.rpartition(":")
    if not colon or " " in spec:
        return spec
    if place.endswith(".py"):
        found = importlib.util.spec_from_file_location(Path(place).stem, place)
        if found is None or not Path(place).is_file():
            raise ValueError(f"no such file: {place}")
        module = importlib.util.module_from_spec(found)
        found.loader.exec_module(module)
    else:
        module = importlib.import_module(place)
    if not hasattr(module, name):
        raise ValueError(f"{place} has no {name}")
    return getattr(module, name)


def load_criteria(value: str) -> str:
    if value[:1] != "@":
        return value
    with open(value[1:], encoding="utf-8") as f:
        return f.read().strip()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webloom")
    e = p.add_subparsers(dest="command", required=True).add_parser("extract")
    e.add_argument("seeds", nargs="+")
    e.add_argument("--schema", required=True)
    e.add_argument("--criteria", required=True, help="text, or @file")
    e.add_argument("--pages", required=True, help="Parquet of (url, html), or with --web of the full web table")
    e.add_argument("--web", action="store_true")
    for name in ("redirects", "candidates", "robots"):
        e.add_argument(f"--{name}", help="Parquet table")
    e.add_argument("--max-fetches", type=int)
    e.add_argument("--max-context-tokens", type=int)
    e.add_argument("--max-workers", type=int)
    e.add_argument("--allowed-domain", action="append")
    e.add_argument("--allow-seed-redirect-domains", action="store_true")
    e.add_argument("--user-agent")
    e.add_argument("--robots-overrides")
    e.add_argument("--log-file")
    e.add_argument("--no-cache", action="store_true")
    for name in ("respect-robots", "prefer-seed-domain", "normalize", "seed-is-content", "always-summarize"):
        e.add_argument(f"--{name}", action=argparse.BooleanOptionalAction)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = get_spark()
    read = lambda path: spark.read.parquet(path) if path else None
    pages = read(a.pages)
    if not a.web:
        pages = web.from_pages(pages.select("url", F.col("html")))
    settings = from_environment().with_(max_context_tokens=a.max_context_tokens, max_workers=a.max_workers, always_summarize=a.always_summarize)
    crawler = Crawler(
        load_schema(a.schema), load_criteria(a.criteria), settings=settings, allowed_domains=a.allowed_domain or None, allow_seed_redirect_domains=a.allow_seed_redirect_domains,
        user_agent=a.user_agent, respect_robots=a.respect_robots, robots_overrides=a.robots_overrides, prefer_seed_domain=a.prefer_seed_domain, normalize_html=a.normalize,
        log_file=a.log_file, cache=None if a.no_cache else _DEFAULT,
    )
    result = crawler.extract(spark, Web(pages, read(a.redirects), read(a.candidates), read(a.robots)), a.seeds, a.max_fetches, seed_is_content=a.seed_is_content)
    print(result.to_json())
    return result.exit_code


if __name__ == "__main__":
    code = main()
    sys.exit(code)
