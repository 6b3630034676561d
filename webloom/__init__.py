"""Spark-native goal-directed web traversal and structured extraction."""

from .plans.crawl import Crawler, LiveWeb, Web
from .plans.result import CrawlResult, Usage, Verdict
from .settings import Settings

__all__ = ["Crawler", "CrawlResult", "LiveWeb", "Settings", "Usage", "Verdict", "Web"]
