"""A provider that asks a model over HTTP: any server of the common chat-completions interface.

Instructions and criterion make the stable first message, so a server's prompt cache can serve it; what differs from page to
page is the second. With ``tier`` each request names that service tier, and one that is refused for lack of capacity is sent
once more without. Rate limits and server errors are tried again with growing pauses.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from .base import Call, CallProvider

SCREEN = "Decide whether the page is what the criterion asks for. Judge what the page itself says, not what it links to. Give match and a reason of one sentence."
SCORE = "Give each link a score from 0 to 1: how likely it is to lead, in one step or a few, to pages that the criterion asks for. Score only the links that are listed, by their exact URLs."
SUMMARIZE = "Shorten the text to what the criterion needs. Keep names, numbers, dates, links and the source lines; leave nothing out that would answer it and add nothing."
EXTRACT = "Fill the schema from the text alone. Leave out what the text doesn't say."
SCREEN_SEED = "The page is told to be on the starting site or not. Off it, ask for clearer evidence before a match; a page that clearly is one stays one."
SCORE_SEED = "Each link is told to be on the starting site or not. Of links that promise as much, those off it score lower."
OUTLINE = "What is kept will fill these fields; write prose, not JSON:"
PAUSES = (1.0, 2.0, 4.0, 8.0)

_SCREENED = {"type": "object", "properties": {"match": {"type": "boolean"}, "reason": {"type": "string"}}, "required": ["match", "reason"], "additionalProperties": False}
_LINK = {"type": "object", "properties": {"url": {"type": "string"}, "score": {"type": "number"}}, "required": ["url", "score"], "additionalProperties": False}
_SCORED = {"type": "object", "properties": {"scores": {"type": "array", "items": _LINK}}, "required": ["scores"], "additionalProperties": False}


class HttpProvider(CallProvider):
    name = "http"
    prompts = (SCREEN, SCORE, EXTRACT, SUMMARIZE, SCREEN_SEED, SCORE_SEED, OUTLINE)

    def __init__(self, base_url: str, model_screen: str, model_extract: str, key: str = "", tier: str = "", max_output_tokens: int = 0, parallel: int = 8, timeout: float = 600.0, pauses=PAUSES) -> None:
        self.base_url, self.model_screen, self.model_extract, self.key = base_url.rstrip("/"), model_screen, model_extract, key
        self.tier, self.max_output_tokens, self.parallel, self.timeout, self.pauses = tier, max_output_tokens, parallel, timeout * (3 if tier else 1), tuple(pauses)

    @classmethod
    def from_settings(cls, s) -> "HttpProvider":
        return cls(s.provider_url, s.model_screen, s.model_extract, s.provider_key, s.service_tier, s.max_output_tokens, s.max_workers)

    def _post(self, payload: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        tier = self.tier
        for pause in (*self.pauses, None):
            body = json.dumps(payload | ({"service_tier": tier} if tier else {})).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(f"{self.base_url}/chat/completions", body, headers), timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                said = e.read().decode("utf-8", "replace")
                if tier and e.code == 429 and "resource_unavailable" in said:
                    tier = ""  # no capacity in this tier just now: this call goes out without
                    continue
                if pause is None or e.code != 429 and e.code < 500:
                    raise
            except OSError:
                if pause is None:
                    raise
            time.sleep(pause)
        raise RuntimeError("no answer")

    def ask(self, model: str, system: str, user: str, schema: dict | None, read) -> Call:
        """One call: billed by what the server counts, whether its answer can be read or not."""
        began = time.monotonic()
        payload = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
        if schema is not None:
            payload["response_format"] = {"type": "json_schema", "json_schema": {"name": "answer", "schema": schema}}
        if self.max_output_tokens:
            payload["max_completion_tokens"] = self.max_output_tokens
        answer = self._post(payload)
        used = answer.get("usage") or {}
        call = Call(None, used.get("prompt_tokens") or 0, used.get("completion_tokens") or 0, (used.get("prompt_tokens_details") or {}).get("cached_tokens") or 0, time.monotonic() - began)
        try:
            call.value = read(answer["choices"][0]["message"]["content"])
        except Exception as e:  # noqa: BLE001 - an answer of another form
            call.error = type(e).__name__
        return call

    def screen_call(self, text, criterion, url, on_seed, seed):
        system, about = f"{SCREEN}\n\nCRITERION:\n{criterion}", ""
        if on_seed is not None:
            system, about = f"{system}\n\n{SCREEN_SEED}", f"START: {seed}\nPAGE: {url}\nON THE STARTING SITE: {on_seed}\n\n"

        def read(content: str) -> tuple[bool, str]:
            said = json.loads(content)
            return bool(said["match"]), str(said.get("reason", ""))

        return self.ask(self.model_screen, system, f"{about}PAGE TEXT:\n{text}", _SCREENED, read)

    def score_call(self, links, text, criterion, on_seeds, seed):
        system = f"{SCORE}\n\nCRITERION:\n{criterion}" + (f"\n\n{SCORE_SEED}" if on_seeds is not None else "")
        rows = [{"url": u, "text": a} | ({"on_starting_site": f} if on_seeds is not None else {}) for (a, u), f in zip(links, on_seeds or [None] * len(links))]
        about = f"START: {seed}\n\n" if on_seeds is not None else ""
        read = lambda content: [(x["url"], float(x["score"])) for x in json.loads(content)["scores"]]
        return self.ask(self.model_screen, system, f"{about}LINKS:\n{json.dumps(rows, ensure_ascii=False)}\n\nPAGE TEXT:\n{text}", _SCORED, read)

    def summarize_call(self, text, criterion, outline):
        system = f"{SUMMARIZE}\n\nCRITERION:\n{criterion}" + (f"\n\n{OUTLINE}\n{outline}" if outline else "")
        return self.ask(self.model_screen, system, text, None, str)

    def extract(self, text, schema=None):
        return self.ask(self.model_extract, EXTRACT, text, schema or {"type": "object"}, json.loads)
