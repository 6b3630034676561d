"""The live source and the model provider against a server in this process."""

import json
import socket
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from html_pages import page
from webloom import Crawler, LiveWeb, Settings
from webloom.providers.http import HttpProvider
from webloom.sources import http

ROBOTS = "User-agent: tester\nDisallow: /secret\n"


class Server:
    """Answers by path; counts what it was asked and with which agent."""

    def __init__(self):
        self.asked, self.agents, self.posts = Counter(), set(), []
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                outer.asked[self.path] += 1
                outer.agents.add(self.headers.get("User-Agent"))
                status, kind, body, more = outer.get(self.path, self.headers)
                if status is None:  # hang up without an answer
                    self.connection.shutdown(socket.SHUT_RDWR)
                    return
                body = body.encode() if isinstance(body, str) else body
                self.send_response(status)
                for k, v in ({"Content-Type": kind, "Content-Length": str(len(body))} | more).items():
                    self.send_header(k, v)
                self.end_headers()
                self.wfile.write(body)

            def do_POST(self):
                asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                outer.posts.append(asked)
                status, answer = outer.post(asked)
                data = json.dumps(answer).encode()
                self.send_response(status)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *_):
                pass

        self.httpd = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.httpd.server_port}"
        threading.Thread(target=self.httpd.serve_forever, daemon=True).start()

    def get(self, path, headers):
        if path == "/":
            return 200, "text/html; charset=utf-8", page("/moved", "/shaky", "/secret", "/blocked", "/paper.pdf", "/image", "/dead"), {}
        if path == "/moved":
            return 302, "text/html", "", {"Location": "/landed"}
        if path == "/to-dead":
            return 302, "text/html", "", {"Location": "/dead"}
        if path == "/landed":
            return 200, "text/html; charset=iso-8859-1", "<p>caf\xe9 goal</p>".encode("latin-1"), {}
        if path == "/shaky":
            return (200, "text/html", "<p>at last</p>", {}) if self.asked[path] > 2 else (503, "text/html", "busy", {})
        if path == "/dead":
            return None, "", "", {}
        if path == "/slow":
            threading.Event().wait(1.5)
            return 200, "text/html", "late", {}
        if path == "/image":
            return 200, "image/png", b"\x89PNG", {}
        if path == "/paper.pdf":
            return 200, "application/pdf", b"%PDF-1.4\nstream\nBT (Paper) Tj ET\nendstream", {}
        if path == "/robots.txt":
            return 203, "text/plain", ROBOTS, {}
        if path.startswith("/reader/"):
            if "/blocked" not in path:
                return 404, "text/html", "", {}
            if headers.get("X-Return-Format") == "html":
                return 200, "text/html", "undefined", {}
            return 200, "text/plain", "Read [here](https://a.b/?x=1&y=2) " + "word " * 60, {}
        if path.startswith("/index?"):
            rows = [["urlkey", "timestamp"], ["k", "20200101000000"]]
            return 200, "application/json", json.dumps(rows if "blocked" in path else [["urlkey", "timestamp"]]), {}
        if path.startswith("/capture/20200101000000/"):
            return 200, "text/html", "<p>" + "captured " * 40 + "</p>", {}
        return 403 if path == "/blocked" else 404, "text/html", "no", {}


@pytest.fixture
def server():
    s = Server()
    yield s
    s.httpd.shutdown()


def live(server, **settings):
    s = Settings(user_agent="tester", reader_url=f"{server.base}/reader/", capture_index_url=f"{server.base}/index", capture_url=server.base + "/capture/{timestamp}/{url}", **settings)
    return http.Live(s, timeout=0.5, pause=0.0)


def test_requests(server):
    get = lambda path, **k: http.request(server.base + path, "tester", 0.5, **k)
    a = get("/moved")
    assert (a.status, a.resolved, a.text) == (200, f"{server.base}/landed", "<p>café goal</p>") and server.agents == {"tester"}
    assert (get("/nothing").status, get("/paper.pdf").text[:8]) == (404, "%PDF-1.4")
    assert (get("/slow").error, get("/dead").error) == ("ReadTimeout", "ReadError")
    assert get("/to-dead").failed == f"{server.base}/dead"  # the address that failed, not the one asked for
    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        closed = f"http://127.0.0.1:{s.getsockname()[1]}/"
    assert http.request(closed, timeout=0.5).error == "ConnectError" and http.request("http://[bad", timeout=0.5).error is not None
    limit = lambda path, n: (http.tried(lambda: get(path), n, lambda a: a.error is not None or a.status >= 500, 0, 0), server.asked[path])
    assert (limit("/shaky", 3)[0].text, server.asked["/shaky"]) == ("<p>at last</p>", 3)
    server.asked.clear()
    assert limit("/slow", 5)[1] == 2 and limit("/dead", 4)[1] == 4  # timeouts of reading once more at most


def test_recovery_routes(server):
    url = f"{server.base}/blocked"
    body, kind, via = live(server)._jina(url)
    assert via == "jina" and kind.startswith("text/html") and body.startswith('Read <a href="https://a.b/?x=1&amp;y=2">here</a>')
    assert server.asked[f"/reader/{url}"] == 2  # the HTML form had no markup, so the default was asked for
    assert live(server)._jina(f"{server.base}/other") is None and live(server, wayback_max_age_days=30)._wayback(url) is None
    assert live(server)._wayback(url)[2] == "wayback:20200101000000" and live(server)._wayback(f"{server.base}/none") is None
    assert http.Live(Settings())._jina(url) is None and http.Live(Settings())._wayback(url) is None


@pytest.mark.usefixtures("small_plans")
def test_live_crawl(spark, server, capsys):
    from webloom.providers.base import FunctionProvider

    provider = FunctionProvider(lambda t, c: (True, "r"), lambda ls, t, c: [(u, 0.9) for _, u in ls])
    settings = live(server).settings
    web = LiveWeb(live(server))
    r = Crawler("a string", "goal", settings=settings, provider=provider, cache=None, respect_robots=True, allowed_domains=[]).extract(spark, web, server.base + "/", 20)
    path = [u.removeprefix(server.base) for u in r.path]
    assert path[0] == "/" and set(path) == {"/", "/landed", "/shaky", "/blocked", "/paper.pdf", "/image", "/dead"}
    assert {k.removeprefix(server.base): v for k, v in r.fallbacks_used.items()} == {"/blocked": "jina"}
    assert {v.url.removeprefix(server.base) for v in r.verdicts} == {"/", "/landed", "/shaky", "/blocked", "/paper.pdf"} and r.pages_fetched == 5
    assert server.asked["/robots.txt"] == 1 and server.asked["/secret"] == 0 and server.asked["/moved"] == 1 and server.asked["/shaky"] == 3
    said = capsys.readouterr().err
    assert "in_chars=5 " in said and "[blocked] https://a.b/?x=1&y=2" in said  # the PDF's one word; the link of the recovered page
    assert f"[robots] {server.base}/secret" in said and f"[transport] ReadError on {server.base}/dead" in said


def answering(content, **usage):
    return lambda asked: (200, {"choices": [{"message": {"content": content if isinstance(content, str) else json.dumps(content)}}], "usage": usage})


def test_provider_calls(server):
    p = HttpProvider(server.base, "small", "large", "key", max_output_tokens=99, pauses=(0, 0))
    server.post = answering({"match": True, "reason": "it is"}, prompt_tokens=10, completion_tokens=3, prompt_tokens_details={"cached_tokens": 4})
    call = p.screen_call("text", "criterion", "http://p/", "no", "http://seed/")
    assert call.value == (True, "it is") and (call.input_tokens, call.output_tokens, call.cached_input_tokens) == (10, 3, 4)
    asked = server.posts[-1]
    assert asked["model"] == "small" and asked["max_completion_tokens"] == 99 and "criterion" in asked["messages"][0]["content"] and "service_tier" not in asked
    assert "http://seed/" in asked["messages"][1]["content"] and "ON THE STARTING SITE: no" in asked["messages"][1]["content"]
    assert p.screen_call("text", "criterion", "u", None, "") and "STARTING" not in server.posts[-1]["messages"][1]["content"]
    server.post = answering({"scores": [{"url": "b", "score": 0.5}, {"url": "invented", "score": 1}]}, prompt_tokens=1)
    assert p.score_call([("x", "a"), ("y", "b")], "t", "c", ["yes", "no"], "s").value == [("b", 0.5), ("invented", 1.0)]
    assert json.loads(server.posts[-1]["messages"][1]["content"].split("LINKS:\n")[1].split("\n")[0])[1] == {"url": "b", "text": "y", "on_starting_site": "no"}
    server.post = answering("shorter")
    assert p.summarize_call("long", "c", "fields").value == "shorter" and "fields" in server.posts[-1]["messages"][0]["content"]
    server.post = answering("no JSON", prompt_tokens=7)
    call = p.extract("text", {"type": "object"})
    assert call.value is None and call.error and call.input_tokens == 7  # billed though it can't be read
    assert server.posts[-1]["model"] == "large" and len(p.prompt_signature) == 64


def test_provider_tries_again_and_leaves_a_tier_without_capacity(server):
    answers = iter([(500, {}), (429, {"error": "rate"}), answering("done")(None)])
    server.post = lambda asked: next(answers)
    assert HttpProvider(server.base, "m", "m", pauses=(0, 0)).summarize_call("t", "c", "").value == "done" and len(server.posts) == 3
    server.posts.clear()
    server.post = lambda asked: (429, {"error": {"code": "resource_unavailable"}}) if asked.get("service_tier") else answering("ok")(None)
    assert HttpProvider(server.base, "m", "m", tier="flex", pauses=(0, 0)).summarize_call("t", "c", "").value == "ok"
    assert [x.get("service_tier") for x in server.posts] == ["flex", None]
    server.post = lambda asked: (400, {})
    with pytest.raises(Exception, match="400"):
        HttpProvider(server.base, "m", "m", pauses=(0,)).summarize_call("t", "c", "")


def test_provider_as_columns(spark, server):
    from pyspark.sql import functions as F

    server.post = lambda asked: (400, {}) if "bad page" in asked["messages"][1]["content"] else answering({"match": False, "reason": "no"}, prompt_tokens=5)(None)
    p = HttpProvider(server.base, "small", "large", parallel=4, pauses=())
    rows = spark.createDataFrame([(1, "good page"), (2, "bad page"), (3, None)], "id int, md string").select("id", p.screen(F.col("md"), "c", F.lit("u")).alias("v")).orderBy("id").collect()
    assert (rows[0]["v"]["match"], rows[0]["v"]["usage"]["input_tokens"], rows[0]["v"]["usage"]["model"]) == (False, 5, "small")
    assert rows[1]["v"]["match"] is None and rows[1]["v"]["usage"]["error"] == "HTTPError" and rows[2]["v"] is None
