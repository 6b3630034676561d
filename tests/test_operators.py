import pytest
from pyspark.sql import functions as F

from webloom.functions import tokens
from webloom.operators import cache, consolidate, frontier, hostmemo, links, outline, recovery, usage
from webloom.providers.base import FunctionProvider, RuleProvider, get_provider
from webloom.settings import Settings, attempts, from_environment
from webloom.sources import web


def test_frontier(spark):
    offers = spark.createDataFrame([("a", "A", 0.5, None, 0, 1), ("a", "A2", 0.9, None, 0, 2), ("b", "B", 0.5, None, 0, 0), ("c", "C", 1.0, None, 1, 0), ("k", "K", 1.0, None, 1, 1)], "canon string, url string, score double, source string, pos int, link_pos int")
    known = spark.createDataFrame([("k",)], "canon string")
    new = frontier.push(offers, known, ["pos", "link_pos"], 10)
    assert {(r["canon"], r["url"], r["score"], r["seq"]) for r in new.collect()} == {("b", "B", 0.5, 10 << 44), ("a", "A", 0.5, (10 << 44) + 1), ("c", "C", 1.0, (10 << 44) + (1 << 20))}
    assert [r["canon"] for r in frontier.pop(new, 2).collect()] == ["c", "b"]


def test_fold_first_landing_wins(spark):
    wave = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y"), (3, "z")], "pos int, canon string")
    seen = spark.createDataFrame([("z",)], "canon string")
    assert sorted(r["pos"] for r in frontier.fold(wave, seen).collect()) == [0, 2]


def test_aligned_scores(spark):
    found = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "page int, pos int, link string")
    given = spark.createDataFrame([(1, "a", 0, 0.2), (1, "a", 1, 7.0), (1, "b", 2, -3.0), (1, "invented", 3, 1.0)], "page int, link string, score_pos int, score double")
    assert {r["link"]: r["score"] for r in links.aligned_scores(found, given, "page").collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}


def candidates(spark, rows):
    return spark.createDataFrame([("u", r, i, b, k, r + ":v") for r, i, b, k in rows], web.CANDIDATES)


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("jina", 0, "<p>Home</p>", "text/html"), ("wayback", 1, "<p>" + "word " * 60 + "</p>", "text/html")], "wayback"),
        ([("jina", 0, "<p>Home</p>", "text/html"), ("wayback", 1, "<p>Hi</p>", "text/html")], "jina"),
        ([("jina", 0, "<p>Home</p>", "text/html"), ("wayback", 1, "<p>Homy</p>", "text/html")], "jina"),
        ([("jina", 0, "%PDF", "application/pdf"), ("wayback", 1, "<p>" + "word " * 60 + "</p>", "text/html")], "jina"),
        ([("jina", 0, "", "text/html")], None),
    ],
)
def test_best_candidate(spark, rows, want):
    got = recovery.best_candidate(candidates(spark, rows), 200).first()
    assert (got and got["route"]) == want


def test_routes_and_captures(spark):
    assert recovery.routes(" Wayback,nope, JINA ,") == ["wayback", "jina"]
    rows = spark.createDataFrame([("u", "20240101000000", 200, "old", "text/html"), ("u", "20240105000000", 200, "new", "text/html"), ("u", "20240109000000", 404, "gone", "text/html")], "url string, stamp string, status int, body string, content_type string")
    assert recovery.newest_capture(rows).first()["via"] == "wayback:20240105000000"
    assert recovery.newest_capture(rows, 3, now=F.lit("2024-01-20").cast("timestamp")).count() == 0


def test_fetch(spark, site):
    pages = site({"http://a/ok": "<p>x</p>", "http://a/bad": (503, "busy"), "http://a/to": (403, "no")}, {"http://s/slow": "ReadTimeout", "http://o/off": "ReadTimeout"})
    redirects = spark.createDataFrame([("http://a/from", "http://a/to"), ("http://a/moved", "http://a/ok")], "url string, resolved string")
    body = "<p>" + "word " * 60 + "</p>"
    found = [("http://a/to", "jina", 0, body, "text/html", "jina"), ("http://s/slow", "jina", 0, body, "text/html", "jina")]
    rows = spark.createDataFrame([(u,) for u in ("http://a/ok", "http://a/bad", "http://a/from", "http://a/moved", "http://s/slow", "http://a/none", "http://o/off")], "url string")
    off = spark.createDataFrame([("o",)], "domain string")
    got = {r["url"]: (r["resolved"], r["kind"], r["via"], r["status"]) for r in web.fetch(rows, pages, redirects, spark.createDataFrame(found, web.CANDIDATES), off).collect()}
    assert got == {
        "http://a/ok": ("http://a/ok", "html", None, 200), "http://a/bad": ("http://a/bad", "error", None, 503), "http://a/from": ("http://a/to", "html", "jina", 200),
        "http://a/moved": ("http://a/ok", "html", None, 200), "http://s/slow": ("http://s/slow", "html", "jina", 200), "http://a/none": ("http://a/none", "error", None, 404),
        "http://o/off": ("http://o/off", "error", None, None),
    }


def test_written_off_host_prefers_a_candidate_but_is_asked_without_one(spark, site):
    pages = site({"http://h.example.com/a": "<p>origin</p>", "http://h.example.com/b": "<p>origin</p>"})
    found = spark.createDataFrame([("http://h.example.com/a", "jina", 0, "<p>copy</p>", "text/html", "jina")], web.CANDIDATES)
    rows = spark.createDataFrame([("http://h.example.com/a",), ("http://h.example.com/b",)], "url string")
    got = web.fetch(rows, pages, None, found, spark.createDataFrame([("example.com",)], "domain string"))
    assert {r["url"][-1]: r["body"] for r in got.collect()} == {"a": "<p>copy</p>", "b": "<p>origin</p>"}


def test_robots(spark):
    robots = spark.createDataFrame(
        [("http://a", 200, "text/plain", "User-agent: *\nDisallow: /no\nAllow: /no/yes\n\nUser-agent: bot\nDisallow: /bot"), ("http://b", 200, "text/html", "<html>sensor</html>"), ("http://c", 404, None, "User-agent: *\nDisallow: /")],
        "origin string, status int, content_type string, body string",
    )
    second = spark.createDataFrame([("http://b", 200, "text/plain", "User-agent: *\nDisallow: /x")], robots.schema)
    ask = ["http://a/no", "http://a/no/yes", "http://a/ok", "http://b/x", "http://c/x", "http://d/x", "https://a/no"]
    rows = spark.createDataFrame([(u,) for u in ask], "url string")
    told = lambda agent, esc=None, over=None: [r["allow"] for r in web.allowed(rows, web.policies(robots, esc), agent, overrides=over).sort("url").collect()]
    by_url = lambda flags: dict(zip(sorted(ask), flags))
    assert by_url(told("me")) == {"http://a/no": False, "http://a/no/yes": False, "http://a/ok": True, "http://b/x": True, "http://c/x": True, "http://d/x": True, "https://a/no": True}
    assert by_url(told("mybot/1.0"))["http://a/no"] is True  # its own group, which doesn't name /no
    assert by_url(told("me", second))["http://b/x"] is False
    assert by_url(told("me", None, ["a"]))["http://a/no"] is True


def test_host_memo(spark):
    log = spark.createDataFrame([("silent", True), ("silent", True), ("once", True), ("alive", True), ("alive", True), ("alive", False)], "domain string, silent boolean")
    first = hostmemo.memo(log, "domain", F.col("silent"), 2)
    assert {r["domain"]: r["written_off"] for r in first.collect()} == {"silent": True, "once": False, "alive": False}
    assert not any(r["written_off"] for r in hostmemo.memo(log, "domain", F.col("silent"), 0).collect())
    late = spark.createDataFrame([("silent", 0, True)], "domain string, n_silent long, answered boolean")
    merged = {r["domain"]: (r["n_silent"], r["answered"]) for r in hostmemo.merge(first.drop("written_off"), late).collect()}
    assert merged == {"silent": (2, True), "once": (1, False), "alive": (2, True)}


def test_cache(spark, tmp_path):
    base = dict(criteria="c", schema_json="{}", prompt_signature="p", model_screen="s", model_extract="e", normalize=True)
    stamp = cache.version_stamp(**base)
    assert len(stamp) == 16 and all(cache.version_stamp(**(base | {k: v})) != stamp for k, v in {"criteria": "x", "schema_json": "[]", "model_screen": "t", "normalize": False}.items())
    store = cache.ParquetStore(spark, str(tmp_path / "kv"))
    assert store.table().count() == 0
    row = lambda v: spark.createDataFrame([("page", "k", v)], "namespace string, key string, value string")
    store.upsert(row("9"))
    store.upsert(row("2"))  # later, though less
    assert [tuple(r) for r in store.table().collect()] == [("page", "k", "2")]
    got = spark.createDataFrame([('{"screen_match": true}',), ("junk",), (None,)], "v string").select(cache.from_value(F.col("v")).alias("c")).collect()
    assert (got[0]["c"]["screen_match"], got[0]["c"]["screen_reason"], got[0]["c"]["link_scores"]) == (True, "", []) and got[1]["c"] is None and got[2]["c"] is None
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a")], "g int, k string").groupBy("g").agg(cache.set_fingerprint(F.col("k")).alias("f")).collect()
    assert sets[0]["f"] == sets[1]["f"]


def test_fit_pages(spark):
    pages = spark.createDataFrame([("http://b/", "http://b/", "word " * 400), ("http://a/", "http://A/", "text " * 400)], "canon string, url string, md string")
    fit = lambda provider, most, **kw: consolidate.fit_pages(pages, consolidate.Fit(provider, "c", most, **kw))
    whole = fit(RuleProvider(), 10_000)
    assert not whole.summarized and whole.text.startswith("--- SOURCE: http://A/\ntext") and "\n\n--- SOURCE: http://b/\nword" in whole.text
    assert whole.content_tokens == whole.input_tokens == tokens.count(whole.text)  # summed page by page, yet that of the whole
    always = fit(RuleProvider(20), 10_000, always=True)
    assert always.summarized and always.levels == 1 and always.input_tokens < always.content_tokens == whole.content_tokens
    assert [(r["calls"], r["output_tokens"]) for r in always.usage] == [(2, 10)]
    reduced = fit(RuleProvider(300), 100)
    assert reduced.summarized and reduced.input_tokens <= 100 and reduced.levels > 1
    same = FunctionProvider(lambda t, c: (True, ""), lambda ls, t, c: [])
    cut = fit(same, 50)
    assert cut.input_tokens <= 50 and cut.levels == 2  # nothing shrank: cut at once
    failing = FunctionProvider(lambda t, c: (True, ""), lambda ls, t, c: [], summarize=lambda t, c: 1 / 0)
    with pytest.raises(RuntimeError):
        fit(failing, 50)


def test_chunks_of_the_whole_are_those_counted_one_by_one(spark):
    """The reduce level against a plain version, for any number of ranges; summaries are replayed from the store."""
    texts = {f"http://h/{i:02d}": f"page {i} " * (5 + 7 * i % 40) for i in range(12)}
    pages = spark.createDataFrame([(u, u, t) for u, t in texts.items()], "canon string, url string, md string").repartition(3)
    halve = lambda t, c: t[: len(t) // 2]
    provider = FunctionProvider(lambda t, c: (True, ""), lambda ls, t, c: [], summarize=halve)

    def summary(text):
        return "\n\n".join(halve(x, "") for x in tokens.split(text, 60))

    parts = [f"--- SOURCE: {u}\n{summary(t)}" for u, t in sorted(texts.items())]
    content = tokens.count("\n\n".join(f"--- SOURCE: {u}\n{t}" for u, t in sorted(texts.items())))
    levels, size = 1, tokens.count("\n\n".join(parts))
    while size > 60 and levels < 5:
        levels, chunks, start = levels + 1, {}, 0
        for x in parts:
            chunks.setdefault(start // 60, []).append(x)
            start += tokens.count(x + "\n\n-") - 1
        parts = [summary("\n\n".join(c)) for _, c in sorted(chunks.items())]
        before, size = size, tokens.count("\n\n".join(parts))
        if size >= before:
            break
    want = "\n\n".join(parts)
    got = consolidate.fit_pages(pages, consolidate.Fit(provider, "c", 60))
    assert (got.content_tokens, got.levels, got.text) == (content, levels, want if size <= 60 else tokens.split(want, 60)[0]) and levels > 2


def test_summaries_are_replayed(spark, tmp_path):
    pages = spark.createDataFrame([("a", "a", "one two three"), ("b", "b", "four")], "canon string, url string, md string")
    store = cache.ParquetStore(spark, str(tmp_path / "kv"))
    provider = FunctionProvider(lambda t, c: (True, ""), lambda ls, t, c: [], summarize=lambda t, c: t.upper())
    fit = lambda provider, version: consolidate.fit_pages(pages, consolidate.Fit(provider, "c", 1000, True, store=store, version=version))
    first = fit(provider, "v")
    assert sum(r["calls"] for r in first.usage) == 2 and "ONE TWO THREE" in first.text
    failing = FunctionProvider(lambda t, c: (True, ""), lambda ls, t, c: [], summarize=lambda t, c: 1 / 0)
    assert fit(failing, "v").text == first.text and fit(failing, "v").usage == ()
    with pytest.raises(RuntimeError):
        fit(failing, "another")


def test_usage(spark):
    rows = spark.createDataFrame([("screen", "a", 1, 5, 1, 1, 0), ("screen", "b", 2, 7, 2, 1, 3), ("extract", "x", 3, 9, 9, 1, 0)], "function string, model string, seq int, input_tokens long, output_tokens long, calls long, cached_input_tokens long")
    total = usage.by_function(rows)
    assert {r["function"]: (r["input_tokens"], r["calls"], r["model"]) for r in total.collect()} == {"screen": (12, 2, "b"), "extract": (9, 1, "x")}
    start = usage.by_function(rows.where("seq <> 2"))
    assert [(r["function"], r["input_tokens"]) for r in usage.delta(start, total).collect()] == [("screen", 7)]


def test_outline():
    node = {"properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/N"}}, "name": {"type": "string", "description": "the\n name"}}, "required": ["name"]}
    assert outline.outline({"$ref": "#/$defs/N", "$defs": {"N": node}}) == "N:\n  kids: list[N]\n  name: string (required) -- the name"
    doc = {
        "title": "R", "description": "d", "$defs": {"E": {"enum": [1, "b"]}, "Z": {"properties": {}}},
        "properties": {"a": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "e": {"allOf": [{"$ref": "#/$defs/E"}]}, "m": {"type": "object", "additionalProperties": {"type": "integer"}}, "t": {"type": ["string", "null"]}, "x": {}},
    }
    assert outline.outline(doc) == "R:\n  # d\n  a: string?\n  e: E\n  m: dict[string, integer]\n  t: string?\n  x: any\n\nE: one of 1|b\n\nZ:\n  # (no fields)"
    kind = outline.to_spark(outline.json_schema("a array<struct<b: string not null>>, m map<string, bigint>"))
    assert kind.simpleString() == "struct<a:array<struct<b:string>>,m:map<string,bigint>>"
    assert outline.outline_or_json(object()) == "Root:\n  # (no fields)"
    assert outline.outline_or_json({"properties": [1]}) == '{"properties":[1]}'
    assert outline.outline({"properties": {"a": {"oneOf": [{"type": "integer"}, {"$ref": "#/$defs/Q"}]}, "b": {"type": "array"}, "c": {"type": "object"}, "d": None}}) == "Root:\n  a: integer | Q\n  b: list[any]\n  c: object\n  d: any"


def test_settings_and_providers(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nWEBLOOM_MAX_FETCHES=3\nWEBLOOM_NORMALIZE=false\n")
    s = from_environment({"WEBLOOM_MAX_FETCHES": "5"}, str(env))
    assert s == Settings(max_fetches=5, normalize=False)
    assert [attempts(e, n) for e, n in (("ReadTimeout", 3), ("ReadTimeout", 1), ("ConnectError", 3), ("ReadTimeout", 0))] == [2, 1, 3, 1]
    assert isinstance(get_provider("rule"), RuleProvider)
    with pytest.raises(ValueError):
        get_provider("nope")
