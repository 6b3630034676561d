"""The live web as a source: pages, robots.txt and recovery routes over HTTP, in Arrow batches on the executors.

Requests of a batch run in threads. Redirects are followed; a request that fails in transport or is answered with 500 or more
is tried again with growing pauses, timeouts of reading at most once more. What is given is rows, so a wave's answers can be
written once and read by every step that needs them.
"""

from __future__ import annotations

import datetime
import http.client
import json
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from webloom.operators.recovery import routes as known_routes
from webloom.settings import Settings, attempts

from .web import CANDIDATES

ANSWERS = "url string, resolved string, status int, content_type string, body string, error string, failed string"
ROBOTS = "origin string, status int, content_type string, body string"
TRANSIENT = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Answer:
    status: int | None = None
    content_type: str = ""
    data: bytes = b""
    resolved: str = ""
    error: str | None = None
    failed: str | None = None

    @property
    def text(self) -> str:
        """PDFs as they are, byte for character; all else by the charset that is told."""
        if "pdf" in self.content_type.lower():
            return self.data.decode("latin-1")
        charset = self.content_type.lower().partition("charset=")[2].split(";")[0].strip(" \"'") or "utf-8"
        try:
            return self.data.decode(charset, "replace")
        except LookupError:
            return self.data.decode("utf-8", "replace")


class _Redirects(urllib.request.HTTPRedirectHandler):
    """Remembers the address that was asked last, to which a failure belongs."""

    def __init__(self, url: str) -> None:
        self.last = url

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        self.last = newurl
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def failure(e: BaseException) -> str:
    """The name of a transport failure; those of ``recovery.SILENT`` mean that no answer came."""
    reason = e.reason if isinstance(e, urllib.error.URLError) else e
    if isinstance(reason, (TimeoutError, socket.timeout)):
        return "ConnectTimeout" if isinstance(e, urllib.error.URLError) else "ReadTimeout"
    if isinstance(e, urllib.error.URLError):
        return "ConnectError" if isinstance(reason, OSError) else type(reason).__name__
    if isinstance(e, (ConnectionError, http.client.RemoteDisconnected, http.client.IncompleteRead)):
        return "ReadError"
    return type(e).__name__


def request(url: str, agent: str = "", timeout: float = 30.0, headers: dict | None = None) -> Answer:
    """One GET; any failure is an answer with its name."""
    follow = _Redirects(url)
    try:
        asked = urllib.request.Request(urllib.parse.quote(url, safe="%/:=&?~#+!$,;'@()*[]"), headers=({"User-Agent": agent} if agent else {}) | (headers or {}))
        opener = urllib.request.build_opener(follow)
        try:
            with opener.open(asked, timeout=timeout) as r:
                return Answer(r.status, r.headers.get("Content-Type", ""), r.read(), r.url)
        except urllib.error.HTTPError as r:
            return Answer(r.code, r.headers.get("Content-Type", "") or "", r.read(), r.url or url)
    except Exception as e:  # noqa: BLE001 - one bad address costs itself only
        return Answer(resolved=url, error=failure(e), failed=follow.last)


def tried(ask: Callable[[], Answer], limit: int, again: Callable[[Answer], bool], first_pause: float, most_pause: float) -> Answer:
    """Asks until the answer needn't be asked for again or the attempts are used up; pauses double."""
    pause, n = first_pause, 1
    while True:
        answer = ask()
        if not again(answer) or n >= attempts(answer.error or "", limit):
            return answer
        time.sleep(min(pause, most_pause))
        pause, n = pause * 2, n + 1


@dataclass(frozen=True)
class Live:
    """Where and how to ask; ``pause`` scales the waits (0 in tests)."""

    settings: Settings = Settings()
    timeout: float = 30.0
    pause: float = 1.0
    threads: int = 8

    def _each(self, rows: DataFrame, call: Callable[[str], list[tuple]], schema: str) -> DataFrame:
        """Rows of ``schema`` that ``call`` gives for each value of the one column of ``rows``."""
        names = [part.split()[0] for part in schema.split(", ")]
        kinds = [pa.int32() if part.endswith(" int") else pa.string() for part in schema.split(", ")]
        threads = self.threads

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with ThreadPoolExecutor(threads) as pool:
                for batch in batches:
                    found = [row for each in pool.map(call, batch.column(0).drop_null().to_pylist()) for row in each]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=names)

        return rows.mapInArrow(run, schema)

    def answers(self, urls: DataFrame) -> DataFrame:
        """ANSWERS of the column of URLs: 500s and transport failures are tried ``fetch_attempts`` times."""
        s, timeout, pause = self.settings, self.timeout, self.pause

        def call(url: str) -> list[tuple]:
            a = tried(lambda: request(url, s.user_agent, timeout), s.fetch_attempts, lambda a: a.error is not None or a.status >= 500, pause, 8 * pause)
            return [(url, a.resolved, a.status, a.content_type, a.text, a.error, a.failed)]

        return self._each(urls, call, ANSWERS)

    def robots(self, origins: DataFrame) -> DataFrame:
        """ROBOTS of the column of origins: asked once, with a short timeout; a failure has no status."""
        s, timeout = self.settings, min(10.0, self.timeout)

        def call(origin: str) -> list[tuple]:
            a = request(f"{origin}/robots.txt", s.user_agent, timeout)
            return [(origin, a.status, a.content_type, a.text)]

        return self._each(origins, call, ROBOTS)

    def candidates(self, urls: DataFrame) -> DataFrame:
        """CANDIDATES for URLs whose origin gave no content: by the reader and the archive, in the configured order."""
        routes = [(r, getattr(self, f"_{r}")) for r in known_routes(self.settings.fetch_fallbacks) if r in ("jina", "wayback")]

        def call(url: str) -> list[tuple]:
            found = []
            for i, (name, route) in enumerate(routes):
                got = route(url)
                if got is not None:
                    found.append((url, name, i, *got))
            return found

        return self._each(urls, call, CANDIDATES)

    def _get(self, url: str, headers: dict | None = None) -> Answer:
        ask = lambda: request(url, self.settings.user_agent, self.timeout, headers)
        return tried(ask, 3, lambda a: a.error is not None or a.status in TRANSIENT, 2 * self.pause, 20 * self.pause)

    def _jina(self, url: str) -> tuple[str, str, str] | None:
        """By a reader service at ``reader_url``: its HTML, or its default text as HTML where the HTML has no markup."""
        s = self.settings
        if not s.reader_url:
            return None
        form = s.jina_return_format.strip()
        a = self._get(s.reader_url + url, {"X-Return-Format": form} if form else {})
        if a.status == 200 and form.lower() == "html" and "<" not in a.text[:2000] and a.text.strip():
            form, a = "", self._get(s.reader_url + url)
        if a.status != 200 or not a.text.strip():
            return None
        return a.text if form.lower() == "html" else as_html(a.text), "text/html; charset=utf-8", "jina"

    def _wayback(self, url: str) -> tuple[str, str, str] | None:
        """By an archive: its newest capture with status 200, unless that is older than ``wayback_max_age_days``."""
        s = self.settings
        if not s.capture_index_url or not s.capture_url:
            return None
        query = urllib.parse.urlencode({"url": url, "output": "json", "limit": "-1", "filter": "statuscode:200", "fastLatest": "true"})
        index = self._get(f"{s.capture_index_url}?{query}")
        try:
            stamp = json.loads(index.text)[1:][-1][1] if index.status == 200 else None
        except (ValueError, LookupError, TypeError):
            return None
        if not isinstance(stamp, str) or _older(stamp, s.wayback_max_age_days):
            return None
        a = self._get(s.capture_url.format(timestamp=stamp, url=url))
        return (a.text, a.content_type, f"wayback:{stamp}") if a.status == 200 and a.data else None


def _older(stamp: str, days: int) -> bool:
    try:
        taken = datetime.datetime.strptime(stamp, "%Y%m%d%H%M%S").replace(tzinfo=datetime.UTC)
    except ValueError:
        return False
    return days > 0 and datetime.datetime.now(datetime.UTC) - taken > datetime.timedelta(days=days)


def as_html(markdown: str) -> str:
    """``text.markdown_to_html`` of one text."""
    import re

    escaped = markdown.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return re.sub(r"\[([^\n\]]*)\]\((https?://[^\s)]+)\)", lambda m: f'<a href="{m[2].replace(chr(34), "&quot;")}">{m[1]}</a>', escaped)
