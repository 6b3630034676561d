"""Settings of a crawl, from arguments, the environment (``WEBLOOM_*``) or a ``.env`` file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    provider: str = "rule"
    provider_url: str = ""
    provider_key: str = ""
    service_tier: str = ""
    model_screen: str = "rule-screen"
    model_extract: str = "rule-extract"
    normalize: bool = True
    follow_pdf: bool = True
    fetch_attempts: int = 3
    transport_memo_failures: int = 2
    fetch_fallbacks: str = "jina,wayback"
    jina_return_format: str = "html"
    wayback_max_age_days: int = 0
    min_recovered_text_chars: int = 200
    reader_url: str = ""
    capture_index_url: str = ""
    capture_url: str = ""
    impersonate: str = ""
    impersonate_domains: str = ""
    max_fetches: int = 10
    seed_is_content: bool = False
    max_context_tokens: int = 128_000
    always_summarize: bool = False
    max_output_tokens: int = 0
    max_workers: int = 8
    tiktoken_encoding: str = ""
    prefer_seed_domain: bool = False
    user_agent: str = "webloom/0.1"
    respect_robots: bool = False
    robots_overrides: str = ""
    llm_cache: str = ""
    log_file: str = ""

    def with_(self, **changes) -> "Settings":
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


def from_environment(env: dict | None = None, dotenv: str | None = ".env") -> Settings:
    """Defaults, overlaid by a ``.env`` file and then by the environment."""
    values: dict[str, str] = {}
    if dotenv and Path(dotenv).is_file():
        for line in Path(dotenv).read_text().splitlines():
            name, found, value = line.partition("=")
            if found and not line.lstrip().startswith("#"):
                values[name.strip().upper()] = value.strip().strip("'\"")
    values |= dict(os.environ if env is None else env)
    out = {}
    for f in fields(Settings):
        raw = values.get(f"WEBLOOM_{f.name.upper()}")
        if raw is not None:
            kind = type(f.default)
            out[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return Settings(**out)


def attempts(error: str, limit: int) -> int:
    """How often a request is tried: once at least, timeouts of reading at most twice, however high the limit."""
    return min(max(1, limit), 2) if error == "ReadTimeout" else max(1, limit)


def attempts_column(error, limit):
    """``attempts`` of columns."""
    from pyspark.sql import functions as F

    most = F.greatest(F.lit(1), limit)
    return F.when(error == "ReadTimeout", F.least(most, F.lit(2))).otherwise(most)
