"""The model-backed operators as columns. A provider's methods take and give columns, so a plan stays one plan."""

from __future__ import annotations

import hashlib
import inspect
import json
import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCREEN_CHARS, SCORE_CHARS = 16_000, 4_000
#: What one call used; error names a failure after which the call was billed or not (null tokens: not known).
USAGE = "struct<model: string, input_tokens: long, output_tokens: long, cached_input_tokens: long, in_chars: long, elapsed: double, error: string>"
SCREENED = f"struct<match: boolean, reason: string, usage: {USAGE}>"
SCORED = f"struct<scores: array<double>, usage: {USAGE}>"
SUMMARIZED = f"struct<text: string, usage: {USAGE}>"


@dataclass
class Call:
    """What a call gives and used."""

    value: Any = None
    input_tokens: int = 0
    output_tokens: int = 0
    cached_input_tokens: int = 0
    elapsed: float = 0.0
    error: str | None = None


class Provider(ABC):
    """on_seed: whether the page is on a seed's domain, as yes, no or unknown; on_seeds: the same of each link. Null unless asked for."""

    name = "provider"
    model_screen = ""
    model_extract = ""
    prompts: tuple[str, ...] = ()

    @property
    def prompt_signature(self) -> str:
        return hashlib.sha256("\0".join(self.prompts).encode()).hexdigest() if self.prompts else ""

    @abstractmethod
    def screen(self, page: Column, criterion: str, url: Column, on_seed: Column | None = None, seed: str = "") -> Column:
        """SCREENED of a page; match is null where the call failed. Sees the page's first 16,000 characters."""

    @abstractmethod
    def score(self, links: Column, page: Column, criterion: str, on_seeds: Column | None = None, seed: str = "") -> Column:
        """SCORED, aligned with the links (array<struct<anchor, url>>): null for those left out, null scores where the call failed."""

    @abstractmethod
    def summarize(self, text: Column, criterion: str, outline: str = "") -> Column:
        """SUMMARIZED: a shorter text that keeps what the criterion needs; null where the call failed."""

    @abstractmethod
    def extract(self, text: str, schema: dict | None = None) -> Call:
        """The one extraction over the consolidated text; its value is a dict, or None."""


def _usage(model: str, given: Column, made: Column) -> Column:
    """Usage where nothing counts tokens: four characters each."""
    tokens = lambda text: F.ceil(F.length(text) / 4).cast("long")
    none = F.lit(0).cast("long")
    return F.struct(
        F.lit(model).alias("model"), F.coalesce(tokens(given), none).alias("input_tokens"), F.coalesce(tokens(made), none).alias("output_tokens"), none.alias("cached_input_tokens"),
        F.coalesce(F.length(given).cast("long"), none).alias("in_chars"), F.lit(0.0).alias("elapsed"), F.lit(None).cast("string").alias("error"),
    )


class CallProvider(Provider):
    """A provider of calls that Python makes: each a function of one page, run in Arrow batches on the executors, ``parallel`` at a time."""

    parallel = 1

    @abstractmethod
    def screen_call(self, text: str, criterion: str, url: str, on_seed: str | None, seed: str) -> Call:
        """Value: (match, reason)."""

    @abstractmethod
    def score_call(self, links: list[tuple[str, str]], text: str, criterion: str, on_seeds: list | None, seed: str) -> Call:
        """links: (anchor, url); value: pairs of url and score."""

    @abstractmethod
    def summarize_call(self, text: str, criterion: str, outline: str) -> Call: ...

    def _column(self, kind: str, model: str, call, shape, columns: list[Column], chars) -> Column:
        parallel = max(1, self.parallel)

        def one(row: tuple):
            if row[0] is None:
                return None
            began = time.monotonic()
            try:
                done = call(*row)
                value, error = shape(done.value, *row), done.error
            except Exception as e:  # noqa: BLE001 - a failed call costs its page alone
                done, value, error = Call(), shape(None, *row), type(e).__name__
            usage = {"model": model, "in_chars": chars(*row), "elapsed": done.elapsed or time.monotonic() - began, "error": error}
            return value | {"usage": usage | {k: getattr(done, k) for k in ("input_tokens", "output_tokens", "cached_input_tokens")}}

        @F.arrow_udf(kind)
        def run(*parts: pa.Array) -> pa.Array:
            rows = list(zip(*(p.to_pylist() for p in parts)))
            if parallel == 1:
                out = [one(r) for r in rows]
            else:
                with ThreadPoolExecutor(parallel) as pool:
                    out = list(pool.map(one, rows))
            return pa.array(out, _arrow(kind))

        return run(*columns)

    def screen(self, page, criterion, url, on_seed=None, seed=""):
        call = lambda text, url, flag: self.screen_call(text, criterion, url or "", flag, seed)
        shape = lambda value, *_: {"match": None, "reason": None} if value is None else {"match": bool(value[0]), "reason": value[1]}
        return self._column(SCREENED, self.model_screen, call, shape, [F.substring(page, 1, SCREEN_CHARS), url, on_seed if on_seed is not None else F.lit(None).cast("string")], lambda text, *_: len(text))

    def score(self, links, page, criterion, on_seeds=None, seed=""):
        call = lambda links, text, flags: self.score_call([(x["anchor"], x["url"]) for x in links], text or "", criterion, flags, seed)

        def shape(value, links, *_):
            given = None if value is None else dict(value)
            return {"scores": None if given is None else [given.get(x["url"]) for x in links]}

        return self._column(SCORED, self.model_screen, call, shape, [links, F.substring(page, 1, SCORE_CHARS), on_seeds if on_seeds is not None else F.lit(None).cast("array<string>")], lambda links, text, *_: len(text or ""))

    def summarize(self, text, criterion, outline=""):
        call = lambda text: self.summarize_call(text, criterion, outline)
        return self._column(SUMMARIZED, self.model_screen, call, lambda value, text: {"text": value}, [text], len)


def _arrow(kind: str) -> pa.DataType:
    usage = pa.struct([("model", pa.string()), *[(c, pa.int64()) for c in ("input_tokens", "output_tokens", "cached_input_tokens", "in_chars")], ("elapsed", pa.float64()), ("error", pa.string())])
    own = {SCREENED: [("match", pa.bool_()), ("reason", pa.string())], SCORED: [("scores", pa.list_(pa.float64()))], SUMMARIZED: [("text", pa.string())]}[kind]
    return pa.struct([*own, ("usage", usage)])


class FunctionProvider(CallProvider):
    """A provider of plain Python functions; those that take ``on_seed`` (``on_seeds``) are told it. Tokens are four characters each."""

    name = "function"

    def __init__(
        self,
        screen: Callable[..., tuple[bool, str]],
        score: Callable[..., Any],
        summarize: Callable[[str, str], str] = lambda text, criterion: text,
        extract: Callable[[str, dict | None], dict | None] = lambda text, schema: {},
        model_screen: str = "function",
        model_extract: str = "function",
    ) -> None:
        self._screen, self._score, self._summarize, self._extract = screen, score, summarize, extract
        self.model_screen, self.model_extract = model_screen, model_extract
        self._told = {name: name in inspect.signature(f).parameters for name, f in (("on_seed", screen), ("on_seeds", score))}

    def _call(self, value, given: str, made: str) -> Call:
        return Call(value, -(-len(given) // 4), -(-len(made) // 4))

    def screen_call(self, text, criterion, url, on_seed, seed):
        value = self._screen(text, criterion, **({"on_seed": on_seed} if self._told["on_seed"] else {}))
        return self._call(value, text, str(value[1]))

    def score_call(self, links, text, criterion, on_seeds, seed):
        value = list(self._score(links, text, criterion, **({"on_seeds": on_seeds} if self._told["on_seeds"] else {})))
        return self._call(value, text, "".join(str(u) for u, _ in value))

    def summarize_call(self, text, criterion, outline):
        short = self._summarize(text, criterion)
        return self._call(short, text, short)

    def extract(self, text, schema=None):
        value = self._extract(text, schema)
        return self._call(value, text, json.dumps(value))


class RuleProvider(Provider):
    """Deterministic and all in the JVM: a page matches if it has a word of the criterion, a link scores by their share in its text."""

    name = "rule"
    model_screen = "rule-screen"
    model_extract = "rule-extract"

    def __init__(self, keep_chars: int = 2_000) -> None:
        self.keep_chars = keep_chars

    def _words(self, criterion: str) -> list[str]:
        return sorted({w for w in criterion.lower().split() if len(w) > 2}) or [""]

    def screen(self, page, criterion, url, on_seed=None, seed=""):
        given = F.substring(page, 1, SCREEN_CHARS)
        seen = F.lower(given)
        hits = F.array_compact(F.array(*[F.when(F.contains(seen, F.lit(w)), F.lit(w)) for w in self._words(criterion)]))
        reason = F.concat(F.lit("words: "), F.array_join(hits, " "))
        return F.struct((F.size(hits) > 0).alias("match"), reason.alias("reason"), _usage(self.model_screen, given, reason).alias("usage"))

    def score(self, links, page, criterion, on_seeds=None, seed=""):
        words = self._words(criterion)
        scores = F.transform(
            links,
            lambda x: sum((F.contains(F.lower(F.concat_ws(" ", x["anchor"], x["url"])), F.lit(w)).cast("double") for w in words), F.lit(0.0)) / len(words),
        )
        return F.when(links.isNotNull(), F.struct(scores.alias("scores"), _usage(self.model_screen, F.substring(page, 1, SCORE_CHARS), F.lit("")).alias("usage")))

    def summarize(self, text, criterion, outline=""):
        short = F.substring(text, 1, self.keep_chars)
        return F.struct(short.alias("text"), _usage(self.model_screen, text, short).alias("usage"))

    def extract(self, text, schema=None):
        sources = [line[len("--- SOURCE: ") :] for line in text.splitlines() if line.startswith("--- SOURCE: ")]
        return Call({"sources": sources}, -(-len(text) // 4), -(-len("".join(sources)) // 4))


_REGISTRY: dict[str, Callable[[], Provider]] = {"rule": RuleProvider}


def register_provider(name: str, factory: Callable[[], Provider]) -> None:
    _REGISTRY[name] = factory


def get_provider(name: str, settings=None) -> Provider:
    """The provider of that name; ``http`` is made from the settings."""
    if name == "http":
        from .http import HttpProvider

        return HttpProvider.from_settings(settings)
    if name not in _REGISTRY:
        raise ValueError(f"no provider {name!r}; there are {sorted(_REGISTRY)}")
    return _REGISTRY[name]()
