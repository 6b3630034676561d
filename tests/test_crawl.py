import json
import random

import pytest

from html_pages import page
from webloom import Crawler, Settings, Web
from webloom.operators.cache import ParquetStore
from webloom.providers.base import FunctionProvider
from webloom.sources import web

SEED = "http://www.site.com/"
pytestmark = pytest.mark.usefixtures("small_plans")


def provider(screen=lambda t, c: (True, "r"), score=lambda ls, t, c: [(u, 0.9) for _, u in ls]):
    return FunctionProvider(screen, score, extract=lambda text, schema: {"sources": [x[12:] for x in text.split("\n") if x.startswith("--- SOURCE")]})


def crawl(spark, tables, seeds=SEED, fetches=None, direct=None, settings=Settings(), **kw):
    kw.setdefault("cache", None)
    kw.setdefault("provider", provider())
    return Crawler("sources array<string>", "goal", settings=settings, **kw).extract(spark, tables, seeds, fetches, seed_is_content=direct)


@pytest.fixture
def graph(site):
    return Web(site({SEED: page("http://docs.site.com/a", "http://other.org/b", "http://portal.net/c"), "http://docs.site.com/a": page(), "http://other.org/b": page(), "http://portal.net/c": page()}))


def test_no_boundary(spark, graph):
    r = crawl(spark, graph)
    assert set(r.path) == {SEED, "http://docs.site.com/a", "http://other.org/b", "http://portal.net/c"} and r.stopped_reason == "match" and r.pages_fetched == 4
    assert r.data["sources"] == sorted(r.path) and r.exit_code == 0
    assert json.loads(r.to_json())["usage_by_function"]["screen"]["calls"] == 4


@pytest.mark.parametrize("allowed, want", [([], {SEED, "http://docs.site.com/a"}), (["portal.net"], {SEED, "http://docs.site.com/a", "http://portal.net/c"})])
def test_boundary(spark, graph, allowed, want):
    assert set(crawl(spark, graph, allowed_domains=allowed).path) == want


def test_seed_redirect_widens_only_when_asked(spark, site):
    tables = Web(site({"http://new.org/": page("http://new.org/x"), "http://new.org/x": page()}), spark.createDataFrame([("http://old.com/", "http://new.org/")], "url string, resolved string"))
    assert crawl(spark, tables, "http://old.com/", allowed_domains=[]).path == ["http://new.org/"]
    assert crawl(spark, tables, "http://old.com/", allowed_domains=[], allow_seed_redirect_domains=True).path == ["http://new.org/", "http://new.org/x"]


def test_budget_and_unreadable_pages(spark, site):
    tables = Web(site({SEED: page("/gone", "/a", "/b"), SEED + "a": page(), SEED + "b": page()}))
    r = crawl(spark, tables, fetches=2)
    assert r.path == [SEED, SEED + "gone", SEED + "a"] and r.pages_fetched == 2
    assert len(r.verdicts) == 2
    with pytest.raises(ValueError):
        crawl(spark, tables, [])


def test_best_first_and_first_score_wins(spark, site):
    score = lambda ls, t, c: [(u, {"/low": 0.1, "/high": 0.8}.get(u[len(SEED) - 1 :], None)) for _, u in ls if "skip" not in u]
    tables = Web(site({SEED: page("/low", "/high", "/skip"), SEED + "low": page(), SEED + "high": page("/low"), SEED + "skip": page()}))
    assert crawl(spark, tables, provider=provider(score=score), settings=Settings(max_workers=1)).path == [SEED, SEED + "high", SEED + "low", SEED + "skip"]


def test_duplicate_landing_is_dropped(spark, site, capsys):
    tables = Web(site({SEED: page("/a", "/b"), SEED + "b": page()}), spark.createDataFrame([(SEED + "a", SEED + "b")], "url string, resolved string"))
    r = crawl(spark, tables)
    assert r.path == [SEED, SEED + "b"] and r.pages_fetched == 2
    assert r.usage_by_function["screen"].calls == 3  # the dropped page's call was made, so it is billed
    assert f"[dedup] {SEED}b → already seen {SEED}b" in capsys.readouterr().err


def test_a_landing_page_is_visited(spark, site, capsys):
    """/from lands on /to, which links to itself: it isn't asked for again. Refused links are told once, by every page that has them."""
    off = "http://other.org/x"
    tables = Web(site({SEED: page("/from", off), SEED + "to": page("/to", "/next", off), SEED + "next": page("/to", off)}), spark.createDataFrame([(SEED + "from", SEED + "to")], "url string, resolved string"))
    r = crawl(spark, tables, allowed_domains=[])
    assert r.path == [SEED, SEED + "to", SEED + "next"]
    said = capsys.readouterr().err
    assert said.count(f"[blocked] {off}") == 1 and "[dedup]" not in said and said.count("[llm screen]") == 3


def test_robots(spark, site):
    tables = Web(site({SEED: page("/no", "/hop"), SEED + "no": page(), "http://www.site.com/no2": page()}), spark.createDataFrame([(SEED + "hop", SEED + "no2")], "url string, resolved string"),
                 robots=spark.createDataFrame([("http://www.site.com", 203, "text/plain", "User-agent: *\nDisallow: /no")], "origin string, status int, content_type string, body string"))
    assert crawl(spark, tables, respect_robots=True).path == [SEED]
    assert len(crawl(spark, tables).path) == 3
    assert len(crawl(spark, tables, respect_robots=True, robots_overrides="site.com").path) == 3


def test_recovery_is_told(spark, site):
    copy = page("/x", text="word " * 60)
    tables = Web(site({SEED: (403, "no"), SEED + "x": page()}), candidates=spark.createDataFrame([(SEED, "jina", 0, copy, "text/html", "jina")], web.CANDIDATES))
    r = crawl(spark, tables)
    assert r.path == [SEED, SEED + "x"] and r.fallbacks_used == {SEED: "jina"}
    assert crawl(spark, tables, settings=Settings(fetch_fallbacks="wayback")).path == [SEED]  # a route that isn't configured isn't taken


def test_routes_are_those_of_the_settings(spark):
    c = spark.createDataFrame([("http://a.com/", r, 9, r, "text/html", r) for r in ("jina", "impersonate", "wayback")] + [("http://b.com/", "impersonate", 9, "x", "text/html", "x")], web.CANDIDATES)
    old = spark.createDataFrame([("http://c.com/", "20200101000000", 200, "old", "text/html")], "url string, stamp string, status int, body string, content_type string")
    of = lambda *a, **k: {(r["url"][7:8], r["route"]): r["route_pos"] for r in web.routed(c, old, *a, **k).collect()}
    assert of(["wayback", "jina"]) == {("a", "wayback"): 1, ("a", "jina"): 2, ("c", "wayback"): 1}
    assert of(["jina", "impersonate"], "chrome") == {("a", "jina"): 1, ("a", "impersonate"): 2, ("b", "impersonate"): 2}
    assert of(["impersonate"], "chrome", ["b.com"]) == {("b", "impersonate"): 1} and of(["impersonate"]) == {}
    assert of(["wayback"], max_age_days=30) == {("a", "wayback"): 1}
    assert web.routed(None, None, ["jina"]) is None and web.routed(c, None, []) is None


def test_versions_and_flags(spark, site):
    """A limit in the schema makes another version; the provider is told which pages and links are on the seed's domain."""
    a, b = ({"properties": {"n": {"type": "integer", "maximum": m}}} for m in (5, 6))
    assert Crawler(a, "c").version == Crawler(dict(a), "c").version != Crawler(b, "c").version and Crawler(a, "c").outline == Crawler(b, "c").outline
    told = lambda text, goal, on_seed=None: (True, on_seed)
    score = lambda ls, t, c, on_seeds=None: [(u, {"yes": 0.9, "no": 0.2}[f]) for (_, u), f in zip(ls, on_seeds)]
    tables = Web(site({SEED: page("http://other.org/b", "/a"), "http://other.org/b": page(), SEED + "a": page()}))
    r = crawl(spark, tables, provider=provider(told, score), prefer_seed_domain=True)
    assert r.path == [SEED, SEED + "a", "http://other.org/b"] and [v.reason for v in r.verdicts] == ["yes", "yes", "no"]


def test_failed_stages_cost_their_page_only(spark, site):
    def screen(text, goal):
        if "blast" in text:
            raise RuntimeError
        return True, "ok"

    tables = Web(site({SEED: page("/boom", "/a"), SEED + "boom": page("/never", text="blast"), SEED + "a": '<p>x</p><a href="https://q[r]s.test/">m</a><a href="/y">y</a>'}))
    r = crawl(spark, tables, provider=provider(screen))
    assert r.path == [SEED, SEED + "boom", SEED + "a"] and [v.url for v in r.verdicts] == [SEED, SEED + "a"] and r.pages_fetched == 3


def test_direct_mode_and_no_match(spark, graph, site):
    r = crawl(spark, graph, direct=True)
    assert r.path == [SEED] and r.data["sources"] == [SEED] and "screen" not in r.usage_by_function
    none = crawl(spark, graph, provider=provider(lambda t, c: (False, "no")))
    assert none.stopped_reason == "budget_exhausted" and none.data is None and none.exit_code == 2 and len(none.verdicts) == 4


def test_second_run_replays(spark, graph, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "kv"))
    first = crawl(spark, graph, cache=store)
    again = crawl(spark, graph, cache=store)
    assert again.path == first.path and again.data == first.data and again.verdicts == first.verdicts and again.usage_by_function == {}
    other = crawl(spark, graph, cache=store, prefer_seed_domain=True)
    assert "screen" in other.usage_by_function


def test_waves_in_parallel_give_the_same_pages(spark, graph):
    assert set(crawl(spark, graph, settings=Settings(max_workers=1)).path) == {SEED, "http://docs.site.com/a", "http://other.org/b", "http://portal.net/c"}


def test_pages_and_order_are_those_of_a_plain_loop(spark, site):
    """A graph of pages with random links, scores, redirects and gaps, three pages a wave, against a loop over lists."""
    rng = random.Random(12)
    name = lambda i: f"{SEED}p{i}"
    links = {i: rng.sample(range(18), rng.randrange(1, 5)) for i in range(14)}  # 14 to 17 don't exist
    redirects = {name(3): name(5), name(16): name(2)}
    score_of = {name(i): round(rng.random(), 3) for i in range(18)}
    pages = {SEED: page(name(0), name(1), name(3))} | {name(i): page(*map(name, own)) for i, own in links.items() if name(i) not in redirects}
    tables = Web(site(pages), spark.createDataFrame(list(redirects.items()), "url string, resolved string"))
    score = lambda ls, t, c: [(u, score_of[u]) for _, u in ls]
    r = crawl(spark, tables, provider=provider(score=score), settings=Settings(max_workers=3), fetches=9)

    ahead, known, landed, path, fetched, seq = [(-9.0, 0, SEED)], {SEED}, set(), [], 0, 1
    while ahead and fetched < 9:
        ahead = sorted(x for x in ahead if x[2] not in landed)
        batch, ahead = ahead[: min(3, 9 - fetched)], ahead[min(3, 9 - fetched) :]
        offers = []
        for _, _, url in batch:
            at = redirects.get(url, url)
            if at in landed:
                continue
            landed.add(at)
            path.append(at)
            if at in pages:
                fetched += 1
                offers += [u for u in ([name(0), name(1), name(3)] if at == SEED else list(map(name, links[int(at.rpartition("p")[2])]))) if u not in known]
        known |= landed
        for u in offers:
            if u not in known:
                known.add(u)
                ahead.append((-score_of[u], seq, u))
                seq += 1
    assert r.path == path and r.pages_fetched == fetched and len(path) > 8


def moved(df):
    """Bytes that the plan's exchanges moved, and the rows."""
    rows, total, plans = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        node = plans.pop()
        if node.metrics().contains("dataSize") and "Shuffle" in node.getClass().getSimpleName():
            total += node.metrics().apply("dataSize").value()
        plans += [node.children().apply(i) for i in range(node.children().size())]
    return total, rows


def test_a_wave_moves_its_own_pages_alone(spark):
    others = [(f"http://www.site.com/{i}", 200, "text/html", "x" * 5_000, None) for i in range(400)]
    found = [("http://nowhere.com/" + str(i), "jina", 0, "y" * 5_000, "text/html", "") for i in range(400)] + [("http://gone.com/", "jina", 0, "<p>body</p>", "text/html", "r")]
    leads = [(f"http://old.com/{i}", f"http://www.site.com/{i}") for i in range(400)] + [("http://old.com/", SEED)]
    tables = Web(
        spark.createDataFrame([(SEED, 200, "text/html", page("http://www.site.com/1"), None), *others], web.WEB),
        spark.createDataFrame(leads, "url string, resolved string"),
        spark.createDataFrame(found, web.CANDIDATES),
    )
    asked = ["http://old.com/", "http://gone.com/", "http://www.site.com/7"]
    batch = spark.createDataFrame([(u, u, 1.0, i, None, i) for i, u in enumerate(asked)], "canon string, url string, score double, seq long, source string, pos int")
    own = {"spark.sql.shuffle.partitions": "4", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = Crawler("sources array<string>", "goal", provider=provider(), cache=None)._outcomes(batch, tables, batch.select("canon"), None, [], None, None, ["site.com"], SEED, False, True)
        size, rows = moved(out)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {r["url"]: (r["resolved"], r["kind"], r["via"], len(r["md"])) for r in rows}
    assert got["http://old.com/"][:3] == (SEED, "html", None) and got["http://gone.com/"][:3] == ("http://gone.com/", "html", "r") and got[asked[2]][3] == 5_000
    assert size < 400_000


def test_pages_linked_to_the_next_of_their_site(spark):
    from webloom.queries import derived_web

    rows = [(None, "http://a.com/n", "n"), (2, "http://a.com/2", "b"), (1, "http://a.com/1", "a"), (3, "http://a.com/2", "c"), (4, "http://b.com/", "d")]
    made = derived_web(spark.createDataFrame(rows, "page_id long, url string, html string"))
    link = lambda u: f'<a href="{u}">policy next</a>'
    want = [("http://a.com/1", "a" + link("http://a.com/2")), ("http://a.com/2", "b" + link("http://a.com/2")), ("http://a.com/2", "c"), ("http://a.com/n", "n" + link("http://a.com/1")), ("http://b.com/", "d")]
    assert sorted((r["url"], r["body"]) for r in made.collect()) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
