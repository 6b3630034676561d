"""The result of a crawl and its JSON form; the audit log."""

from __future__ import annotations

import json
import sys
import time
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Usage:
    calls: int = 0
    input_tokens: int = 0
    cached_input_tokens: int = 0
    output_tokens: int = 0

    def __add__(self, other):
        return Usage(*(a + b for a, b in zip(vars(self).values(), vars(other).values())))


@dataclass(frozen=True)
class Verdict:
    url: str
    match: bool
    reason: str


@dataclass
class CrawlResult:
    data: dict | None
    stopped_reason: str
    pages_fetched: int
    path: list[str]
    verdicts: list[Verdict]
    protocol: str
    usage_by_function: dict[str, Usage] = field(default_factory=dict)
    function_model: dict[str, str] = field(default_factory=dict)
    content_tokens: int = 0
    extraction_input_tokens: int = 0
    summarized: bool = False
    fallbacks_used: dict[str, str] = field(default_factory=dict)

    def to_dict(self) -> dict:
        usage = {
            name: {"model": self.function_model.get(name)} | vars(u)
            for name, u in self.usage_by_function.items()
        }
        plain = ("data", "stopped_reason", "pages_fetched", "protocol", "content_tokens", "extraction_input_tokens", "summarized")
        return {k: getattr(self, k) for k in plain} | {
            "usage_by_function": usage,
            "path": [*self.path],
            "fallbacks_used": {**self.fallbacks_used},
            "verdicts": [{**vars(v)} for v in self.verdicts],
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, ensure_ascii=False)

    @property
    def exit_code(self) -> int:
        return 0 if self.stopped_reason == "match" else 2


class AuditLog:
    """Lines to stderr and, with a file, appended to it with a time stamp; failures to write are let go."""

    def __init__(self, path: str = "") -> None:
        self.path = path

    def __call__(self, line: str) -> None:
        print(line, file=sys.stderr)
        if self.path:
            try:
                with open(self.path, "a", encoding="utf-8") as f:
                    f.write(f"{time.strftime('%F %T')} {line}\n")
            except OSError:
                pass
