"""Each operator as a query over the test tables, and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import html, text, tokens, urls
from webloom.operators import cache, consolidate, frontier, hostmemo, links, outline, recovery, usage
from webloom.plans.crawl import Crawler, Web
from webloom.providers.base import RuleProvider
from webloom.session import local_table, saved, shared_dir
from webloom.settings import Settings, attempts_column
from webloom.sources import web

ALLOWED = ("example.com", "example.org")
CRITERION = "privacy contact policy"
AGENT = "webloom"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.page_links(pages(spark, sf_dir), keep=["page_id", "url"])


def unit(column: Column) -> Column:
    """A number from 0 to 1 that a string fixes; the stand-in for a model's score."""
    return F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("long") / F.lit(4294967295.0)


def domains(spark: SparkSession) -> DataFrame:
    return local_table(spark, [(d,) for d in ALLOWED], "domain string")


_LINKS = r"""
anchors AS (
  SELECT page_id, url, regexp_extract_all(html, '(?s)<a href="[^"]*">.*?</a>') AS l FROM pages
),
hrefs AS (
  SELECT page_id, url, i AS raw_pos, regexp_extract(l[i], '^<a href="([^"]*)">', 1) AS href,
         trim(regexp_replace(regexp_replace(l[i], '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS anchor
  FROM (SELECT page_id, url, l, unnest(range(1, len(l) + 1)) AS i FROM anchors)
),
absolute AS (
  SELECT page_id, url, raw_pos, anchor,
         regexp_replace(CASE WHEN href LIKE '/%' THEN regexp_extract(url, '^https?://[^/?#]*') || href ELSE href END, '#.*$', '') AS link
  FROM hrefs WHERE NOT regexp_matches(href, '^(javascript:|mailto:|tel:|#)') AND href <> ''
),
links AS (
  SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY raw_pos) - 1 AS pos, anchor, link
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, link ORDER BY raw_pos) AS rn FROM absolute WHERE regexp_matches(link, '^https?://'))
  WHERE rn = 1
)"""


def _sql_canon(url: str) -> str:
    enc = lambda x: f"replace(replace(replace(url_encode({x}), '%20', '+'), '%7E', '~'), '*', '%2A')"
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    pairs = f"list_sort([{{'k': url_decode(replace(regexp_extract(p, '^([^=]*)', 1), '+', ' ')), 'v': url_decode(replace(regexp_extract(p, '^[^=]*=(.*)$', 1), '+', ' '))}} for p in string_split({query}, '&') if p <> ''])"
    joined = f"array_to_string([{enc('s.k')} || '=' || {enc('s.v')} for s in {pairs}], '&')"
    path = f"regexp_extract({url}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
    return (
        f"lower(regexp_extract({url}, '^([^:/?#]+)://', 1)) || '://' || lower(regexp_extract({url}, '^[^:/?#]+://([^/?#]*)', 1))"
        f" || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {query} = '' THEN '' ELSE '?' || {joined} END"
    )


_HOST = "regexp_replace(lower(regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1)), ':\\d*$', '')"
_DOMAIN = "regexp_extract(" + _HOST + ", '[^.]+\\.[^.]+$')"
_UNIT = "('0x' || substr(md5({u}), 1, 8))::BIGINT / 4294967295.0::DOUBLE"
_IN = "(" + ", ".join(f"'{d}'" for d in ALLOWED) + ")"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


@query(f"SELECT page_id, url, {_sql_canon('url')} AS canon FROM pages")
def url_canonical(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", "url", urls.canonical(F.col("url")).alias("canon"))


@query(f"""SELECT page_id, lower(regexp_extract(url, '^https?://[^/?#]*')) AS origin, {_DOMAIN.format(u='url')} AS registrable, {_DOMAIN.format(u='url')} AS domain,
CASE WHEN {_DOMAIN.format(u='url')} IN {_IN} THEN 'yes' ELSE 'no' END AS on_seed FROM pages""")
def url_origin_domain(spark, sf_dir):
    own = urls.registrable_domain(urls.host(F.col("url")))
    return pages(spark, sf_dir).select(
        "page_id", urls.origin(F.col("url")).alias("origin"), own.alias("registrable"), urls.domain_of(F.col("url")).alias("domain"), text.yes_no(urls.on_domains(own, ALLOWED)).alias("on_seed")
    )


@query(f"WITH {_LINKS} SELECT page_id, url, pos::INT AS pos, anchor, link FROM links")
def link_extract(spark, sf_dir):
    return all_links(spark, sf_dir)


@query(f"""WITH {_LINKS} SELECT canon, page_id, pos::INT AS pos, link FROM (
SELECT *, row_number() OVER (PARTITION BY canon ORDER BY page_id, pos) AS rn FROM (SELECT *, {_sql_canon('link')} AS canon FROM links)) WHERE rn = 1""")
def link_dedup_first(spark, sf_dir):
    found = all_links(spark, sf_dir).withColumn("canon", urls.canonical(F.col("link")))
    return links.first_by(found, ["canon"], ["page_id", "pos"]).select("canon", "page_id", "pos", "link")


@query(f"""WITH {_LINKS}, known AS (SELECT DISTINCT {_sql_canon('link')} AS canon FROM links WHERE page_id % 3 = 0)
SELECT page_id, pos::INT AS pos, link, canon FROM (SELECT *, {_sql_canon('link')} AS canon FROM links) ANTI JOIN known USING (canon)""")
def links_unknown(spark, sf_dir):
    found = all_links(spark, sf_dir)
    known = found.where("page_id % 3 = 0").select(urls.canonical(F.col("link")).alias("canon")).distinct()  # what a third of the pages has shown before
    return links.unknown(found, known).select("page_id", "pos", "link", "canon")


@query(f"WITH {_LINKS} SELECT page_id, pos::INT AS pos, link FROM links WHERE {_DOMAIN.format(u='link')} IN {_IN}")
def boundary_gate(spark, sf_dir):
    return links.within(all_links(spark, sf_dir), domains(spark)).select("page_id", "pos", "link")


@query(f"WITH {_LINKS} SELECT DISTINCT link, {_DOMAIN.format(u='link')} AS domain FROM links WHERE {_DOMAIN.format(u='link')} NOT IN {_IN}")
def blocked_once(spark, sf_dir):
    return links.blocked_once(all_links(spark, sf_dir), domains(spark))


@query(f"""WITH {_LINKS} SELECT canon, score, seq FROM (SELECT {_sql_canon('url')} AS canon, {_UNIT.format(u='url')} AS score, page_id AS seq FROM pages) ORDER BY score DESC, seq LIMIT 64""")
def frontier_topk(spark, sf_dir):
    ahead = pages(spark, sf_dir).select(urls.canonical(F.col("url")).alias("canon"), unit(F.col("url")).alias("score"), F.col("page_id").alias("seq"))
    return frontier.pop(ahead, 64)


@query(f"""WITH {_LINKS}, offers AS (SELECT {_sql_canon('link')} AS canon, link AS url, {_UNIT.format(u='link')} AS score, url AS source, page_id, pos FROM links),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canon ORDER BY page_id, pos) AS rn FROM offers WHERE canon NOT IN (SELECT {_sql_canon('url')} FROM pages)) WHERE rn = 1)
SELECT canon, url, score, page_id * 1048576 + pos AS seq, source FROM fresh""")
def frontier_push(spark, sf_dir):
    found = all_links(spark, sf_dir)
    offers = found.select(urls.canonical(F.col("link")).alias("canon"), F.col("link").alias("url"), unit(F.col("link")).alias("score"), F.col("url").alias("source"), "page_id", "pos")
    known = pages(spark, sf_dir).select(urls.canonical(F.col("url")).alias("canon"))
    return frontier.push(offers, known, ["page_id", "pos"])


@query("""SELECT canon, doc_id AS pos FROM (SELECT sha256(text) AS canon, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""")
def content_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(text.content_hash(F.col("text")).alias("canon"), F.col("doc_id").alias("pos"))
    return frontier.fold(rows)


@query(f"""SELECT {_DOMAIN.format(u='url')} AS domain, sha256(string_agg(sha256(html), chr(0) ORDER BY sha256(html))) AS fingerprint, count(*) AS n FROM pages GROUP BY 1""")
def page_fingerprint(spark, sf_dir):
    keyed = pages(spark, sf_dir).select(urls.domain_of(F.col("url")).alias("domain"), text.content_hash(F.col("html")).alias("k"))
    return keyed.groupBy("domain").agg(cache.set_fingerprint(F.col("k")).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


_VISIBLE = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(
regexp_replace(regexp_replace(regexp_replace({h}, '<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g'),
'&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, {_VISIBLE.format(h='html')} AS visible, length({_VISIBLE.format(h='html')})::INT AS chars FROM pages")
def visible_text(spark, sf_dir):
    seen = pages(spark, sf_dir).select("page_id", text.visible_text(F.col("html")).alias("visible"))
    return seen.withColumn("chars", F.length("visible"))


@query(f"SELECT page_id, url FROM pages WHERE length({_VISIBLE.format(h='html')}) >= 1500")
def thin_content(spark, sf_dir):
    return pages(spark, sf_dir).where(text.is_substantial(F.col("html"), 1500)).select("page_id", "url")


#: What each route gives of a page: without its paragraphs, without its lists, all of it.
_ROUTES = [("impersonate", r"(?s)<p>.*?</p>"), ("jina", r"(?s)<li>.*?</li>"), ("wayback", "^$")]


@query(
    "WITH c AS ("
    + " UNION ALL ".join(f"SELECT url, '{r}' AS route, {i} AS route_pos, regexp_replace(html, '{cut}', '', 'g') AS body FROM pages" for i, (r, cut) in enumerate(_ROUTES))
    + f"""), s AS (SELECT *, length({_VISIBLE.format(h='body')}) AS chars FROM c)
SELECT url, coalesce(arg_min(route, route_pos) FILTER (chars >= 700), arg_max(route, chars * 10 - route_pos)) AS route,
coalesce(arg_min(chars, route_pos) FILTER (chars >= 700), max(chars))::INT AS chars FROM s GROUP BY url"""
)
def recovery_chain(spark, sf_dir):
    each = F.array(*[F.struct(F.lit(r).alias("route"), F.lit(i).alias("route_pos"), F.regexp_replace("html", cut, "").alias("body")) for i, (r, cut) in enumerate(_ROUTES)])
    candidates = pages(spark, sf_dir).select("url", F.explode(each).alias("c")).select("url", "c.*", F.lit("text/html").alias("content_type"), F.lit("").alias("via"))
    return recovery.best_candidate(candidates, 700).select("url", "route", "chars")


_STATUS = "CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 204 ELSE 200 END"
_TYPE = "CASE page_id % 5 WHEN 0 THEN 'Application/XHTML+xml' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'image/png' ELSE 'text/html; charset=utf-8' END"


@query(f"""SELECT page_id, s::INT AS status, CASE WHEN s NOT BETWEEN 200 AND 299 THEN 'error' WHEN lower(t) LIKE '%html%' THEN 'html' WHEN lower(t) LIKE '%pdf%' THEN 'skipped' ELSE 'skipped' END AS kind,
(s NOT BETWEEN 200 AND 299) AS recover FROM (SELECT page_id, {_STATUS} AS s, {_TYPE} AS t FROM pages)""")
def status_guard(spark, sf_dir):
    p = pages(spark, sf_dir).select("page_id", F.expr(_STATUS).alias("status"), F.expr(_TYPE).alias("t"))
    return p.select("page_id", "status", recovery.kind(F.col("status"), F.col("t"), follow_pdf=False).alias("kind"), (~recovery.usable(F.col("status"))).alias("recover"))


_HOST_KEY = "CAST(user_id AS VARCHAR) || ':' || CAST(CAST(ts AS DATE) AS VARCHAR)"


@query(f"""SELECT host, n_silent, answered, (NOT answered AND n_silent >= 2) AS written_off FROM (
SELECT {_HOST_KEY} AS host, count(*) FILTER (event_type = 'error') AS n_silent, bool_or(event_type <> 'error') AS answered FROM events GROUP BY 1)""")
def host_memo(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").select(F.concat_ws(":", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("host"), "event_type")
    return hostmemo.memo(attempts, "host", F.col("event_type") == "error", 2)


POLICY = "User-agent: webloom\nDisallow: /page/1\nAllow: /page\nDisallow: /post\n\nUser-agent: *\nDisallow: /\n"


@query("""WITH o AS (SELECT page_id, url, lower(regexp_extract(url, '^https?://[^/?#]*')) AS origin, regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS p FROM pages)
SELECT page_id, url, CASE WHEN NOT ends_with(regexp_extract(origin, '://(.*)$', 1), '.com') THEN true
WHEN starts_with(p, '/page/1') THEN false WHEN starts_with(p, '/page') THEN true WHEN starts_with(p, '/post') THEN false ELSE true END AS allow FROM o""")
def robots_gate(spark, sf_dir):
    p = pages(spark, sf_dir)
    origins = p.select(urls.origin(F.col("url")).alias("origin")).distinct()
    # the .com sites have a policy, the .net ones a page where it should be, the others nothing
    answers = origins.select(
        "origin", F.when(F.col("origin").endswith(".org"), 404).otherwise(200).alias("status"),
        F.when(F.col("origin").endswith(".net"), "text/html").otherwise("text/plain").alias("content_type"), F.lit(POLICY).alias("body"),
    )
    return web.allowed(p.select("page_id", "url"), web.policies(answers), AGENT)


@query("""WITH k AS (SELECT doc_id, sha256(text) AS digest FROM documents), kv AS (SELECT digest, max(doc_id) AS seq FROM k WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT doc_id, 'v1:' || digest || ':' || doc_id % 1 AS cache_key, kv.digest IS NOT NULL AS hit, coalesce(seq, -1) AS value FROM k LEFT JOIN kv USING (digest)""")
def cache_replay(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = cache.page_key("v1", text.content_hash(F.col("text")), (F.col("doc_id") % 1).cast("string"))
    keyed = docs.select("doc_id", key.alias("cache_key"))
    # an earlier run has seen the even documents; the last write of a key wins
    kv = keyed.where("doc_id % 2 = 0").groupBy(F.col("cache_key").alias("key")).agg(F.max("doc_id").cast("string").alias("value")).withColumn("namespace", F.lit("page"))
    out = cache.replay(keyed, kv, "page")
    return out.select("doc_id", "cache_key", F.col("value").isNotNull().alias("hit"), F.coalesce(F.col("value").cast("long"), F.lit(-1)).alias("value"))


@query("""SELECT 'conversation' AS namespace, conv_id::VARCHAR AS key, max_by(text, {'t': turn, 'x': text}) AS value FROM conversations GROUP BY 2""")
def kv_upsert(spark, sf_dir):
    """Every turn written under its conversation's key, the later half first: the last turn is what the store has."""
    store = cache.ParquetStore(spark, f"{shared_dir(spark)}/kv-{uuid.uuid4().hex}")
    rows = table(spark, sf_dir, "conversations").select(F.lit("conversation").alias("namespace"), F.col("conv_id").cast("string").alias("key"), F.col("text").alias("value"), "turn")
    for half in ("turn > 2", "turn <= 2 OR turn IS NULL"):
        store.upsert(rows.where(half), F.col("turn"))
    return store.table()


_SCREEN_WORDS = ("contact", "policy", "privacy")


@query(
    "SELECT page_id, "
    + " OR ".join(f"contains(lower(substr(html, 1, 16000)), '{w}')" for w in _SCREEN_WORDS)
    + " AS match, 'words: ' || array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN contains(lower(substr(html, 1, 16000)), '{w}') THEN '{w}' END" for w in _SCREEN_WORDS)
    + "], lambda x: x IS NOT NULL), ' ') AS reason FROM pages"
)
def screen_verdicts(spark, sf_dir):
    verdict = RuleProvider().screen(F.col("html"), CRITERION, F.col("url"))
    return pages(spark, sf_dir).select("page_id", verdict.alias("v")).select("page_id", "v.match", "v.reason")


@query(
    f"WITH {_LINKS} SELECT page_id, pos::INT AS pos, link, ("
    + " + ".join(f"contains(lower(anchor || ' ' || link), '{w}')::INT" for w in _SCREEN_WORDS)
    + ")::DOUBLE / 3 AS score FROM links"
)
def score_links(spark, sf_dir):
    """All links of each page in one call of the provider, its scores aligned with them."""
    found = pages(spark, sf_dir).withColumn("links", html.extract_links(F.col("html"), F.col("url")))
    scored = found.withColumn("given", RuleProvider().score(F.col("links"), F.col("html"), CRITERION)["scores"])
    each = scored.select("page_id", F.posexplode(F.arrays_zip("links", "given")).alias("pos", "x"))
    return each.select("page_id", "pos", F.col("x.links.url").alias("link"), text.clamp(F.col("x.given")).alias("score"))


@query(f"""WITH {_LINKS}, given AS (SELECT page_id, link, max_by(score, score_pos) AS score FROM (
SELECT page_id, link, pos AS score_pos, {_UNIT.format(u='link')} * 3 - 1 AS score FROM links WHERE pos % 3 <> 0 UNION ALL
SELECT page_id, link, 1000 + pos, {_UNIT.format(u='anchor')} FROM links WHERE pos % 5 = 1) GROUP BY 1, 2)
SELECT page_id, pos::INT AS pos, link, CASE WHEN score IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)) END AS score FROM links LEFT JOIN given USING (page_id, link)""")
def aligned_scores(spark, sf_dir):
    found = all_links(spark, sf_dir)
    first = found.where("pos % 3 <> 0").select("page_id", "link", F.col("pos").alias("score_pos"), (unit(F.col("link")) * 3 - 1).alias("score"))
    again = found.where("pos % 5 = 1").select("page_id", "link", (F.col("pos") + 1000).alias("score_pos"), unit(F.col("anchor")).alias("score"))
    return links.aligned_scores(found, first.union(again), "page_id").select("page_id", "pos", "link", "score")


@query(r"""SELECT doc_id, regexp_replace(replace(replace(replace(md, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\[([^\n\]]*)\]\(((?:https|http)://[^\s)]+)\)', '<a href="\2">\1</a>', 'g') AS html
FROM (SELECT doc_id, text || ' <b> & [see ' || lang || '](https://example.com/?a=1&b=' || doc_id || ') [no](/rel)' AS md FROM documents)""")
def md_to_html(spark, sf_dir):
    md = F.concat(F.col("text"), F.lit(" <b> & [see "), F.col("lang"), F.lit("](https://example.com/?a=1&b="), F.col("doc_id").cast("string"), F.lit(") [no](/rel)"))
    return table(spark, sf_dir, "documents").select("doc_id", text.markdown_to_html(md).alias("html"))


_NOTICE = "This field is for validation purposes and should be left unchanged."
#: Of each filter what it must take out (with a part that differs from row to row), and what must stay around it.
_VOLATILE = [
    ("\n\n[mail](/cdn-cgi/l/email-protection", "#{x}", ")"),
    ("\n[by](https://www.foundant.com", ' "at {x}"', ")"),
    ("\n\n", "Name {x}\n\n", _NOTICE),
    ("\nend", "\n## Related Guides & Reports\n\n* {x}\n* more", "\n[![](https://h/EREF-white-logo.svg)](/)"),
    ("", "\n| | {p} |\n| --- | :-: |", "\nlast"),
]


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("SELECT doc_id, sha256(text || " + " || ".join(_sql_text(before + after) for before, _, after in _VOLATILE) + ") AS digest FROM documents")
def text_filters(spark, sf_dir):
    x, pipes = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 12), F.repeat(F.lit("| "), (F.col("doc_id") % 4).cast("int"))
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{x}"), x), F.lit("{p}"), pipes)
    volatile = F.concat(F.col("text"), *[fill(part) for parts in _VOLATILE for part in parts])
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(text.apply_filters(volatile, text.STABLE)).alias("digest"))


@query(f"""SELECT {_DOMAIN.format(u='url')} AS domain, sha256(string_agg('--- SOURCE: ' || url || chr(10) || html, chr(10) || chr(10) ORDER BY {_sql_canon('url')}, '--- SOURCE: ' || url || chr(10) || html)) AS digest FROM pages GROUP BY 1""")
def consolidate_concat(spark, sf_dir):
    p = pages(spark, sf_dir).select(urls.domain_of(F.col("url")).alias("domain"), urls.canonical(F.col("url")).alias("canon"), "url", F.col("html").alias("md"))
    return consolidate.concatenated(p, ["domain"]).select("domain", text.content_hash(F.col("text")).alias("digest"))


def _events(spark, sf_dir):
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select(
        F.col("role").alias("function"), F.concat(F.lit("m"), (F.col("turn") % 2).cast("string")).alias("model"), F.struct("conv_id", "turn", "text").alias("seq"),
        n.alias("input_tokens"), (n / 4).cast("long").alias("output_tokens"), F.lit(1).alias("calls"), (n % 7).alias("cached_input_tokens"), "conv_id",
    )


_USAGE = "sum(length(text))::BIGINT AS input_tokens, sum(length(text) // 4)::BIGINT AS output_tokens, count(*)::BIGINT AS calls, sum(length(text) % 7)::BIGINT AS cached_input_tokens"
_LAST = "max_by('m' || (turn % 2)::VARCHAR, {'c': conv_id, 't': turn, 'x': text}) AS model"


@query(f"SELECT role AS function, {_USAGE}, {_LAST} FROM conversations GROUP BY 1")
def usage_by_function(spark, sf_dir):
    return usage.by_function(_events(spark, sf_dir))


@query(f"SELECT e.function, (e.input_tokens - coalesce(s.input_tokens, 0))::BIGINT AS input_tokens, (e.output_tokens - coalesce(s.output_tokens, 0))::BIGINT AS output_tokens, (e.calls - coalesce(s.calls, 0))::BIGINT AS calls, (e.cached_input_tokens - coalesce(s.cached_input_tokens, 0))::BIGINT AS cached_input_tokens, model FROM (SELECT role AS function, {_USAGE}, {_LAST} FROM conversations GROUP BY 1) e LEFT JOIN (SELECT role AS function, {_USAGE} FROM conversations WHERE turn = 0 GROUP BY 1) s ON e.function = s.function WHERE e.calls <> coalesce(s.calls, 0)")
def usage_delta(spark, sf_dir):
    events = _events(spark, sf_dir)
    first = F.col("seq.turn") == 0  # what had been used when the conversations began
    return usage.delta(usage.by_function(events.where(first)), usage.by_function(events))


@query("SELECT doc_id, i::INT AS pos, substr(text, 1 + i * 500, 500) AS chunk FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 499) // 500))) AS i FROM documents)")
def chunk_split(spark, sf_dir):
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / 500)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * 500 + 1, F.lit(500)))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("pos", "chunk"))


@query()
def token_split(spark, sf_dir):
    """Token-exact chunks; together they are the text."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens.split_by_tokens(256)(F.col("text"))).alias("pos", "c"))
    return chunks.select("doc_id", "pos", "c.chunk", "c.n_tokens")


@query()
def fit_pages(spark, sf_dir):
    p = pages(spark, sf_dir).select(urls.canonical(F.col("url")).alias("canon"), "url", text.visible_text(F.col("html")).alias("md"))
    f = consolidate.fit_pages(p, consolidate.Fit(RuleProvider(200), CRITERION, 4_000))
    return spark.createDataFrame([(f.summarized, f.content_tokens, f.input_tokens, f.levels, f.text)], "summarized boolean, content_tokens long, input_tokens long, levels int, text string")


_OUTLINED = ("documents", "labels", "events", "embeddings", "lineitem")
_KIND = "CASE column_type WHEN 'BIGINT' THEN 'integer' WHEN 'INTEGER' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'FLOAT' THEN 'number' WHEN 'FLOAT[]' THEN 'list[number]' ELSE 'string' END"


@query(
    " UNION ALL ".join(
        f"SELECT '{t}' AS name, 'Root:' || chr(10) || string_agg('  ' || column_name || ': ' || {_KIND} || '?', chr(10) ORDER BY n) AS outline FROM (SELECT *, row_number() OVER () AS n FROM (DESCRIBE {t}))" for t in _OUTLINED
    )
)
def schema_outline(spark, sf_dir):
    """The outlines of the tables' own schemas."""
    return spark.createDataFrame([(t, outline.outline_or_json(table(spark, sf_dir, t).schema)) for t in _OUTLINED], "name string, outline string")


@query("""SELECT page_id, least(length(html), 16000) AS screened, least(length(html), 4000) AS scored, ceil(least(length(html), 16000) / 4)::BIGINT AS screen_tokens,
ceil(least(length(html), 4000) / 4)::BIGINT AS score_tokens FROM pages""")
def prefix_for_model(spark, sf_dir):
    """How much of a page the provider's calls see, and what they bill for it."""
    screen = RuleProvider().screen(F.col("html"), CRITERION, F.col("url"))["usage"]
    score = RuleProvider().score(html.extract_links(F.col("html"), F.col("url")), F.col("html"), CRITERION)["usage"]
    used = pages(spark, sf_dir).select("page_id", screen.alias("a"), score.alias("b"))
    return used.select("page_id", F.col("a.in_chars").alias("screened"), F.col("b.in_chars").alias("scored"), F.col("a.input_tokens").alias("screen_tokens"), F.col("b.input_tokens").alias("score_tokens"))


@query("""WITH c AS (SELECT user_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status FROM events)
SELECT user_id AS url, max(stamp) AS stamp FROM c WHERE status = 200 GROUP BY 1 HAVING strptime(max(stamp), '%Y%m%d%H%M%S') >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 DAYS""")
def newest_capture(spark, sf_dir):
    captures = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("url"), F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.lit("").alias("body"), F.lit("").alias("content_type")
    )
    return recovery.newest_capture(captures, 10, now=F.lit("2024-01-20 00:00:00").cast("timestamp")).select("url", "stamp")


@query(f"""SELECT canon, page_id AS pos FROM (SELECT {_sql_canon('url')} AS canon, page_id, row_number() OVER (PARTITION BY {_sql_canon('url')} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1""")
def resolved_first(spark, sf_dir):
    return frontier.fold(pages(spark, sf_dir).select(urls.canonical(F.col("url")).alias("canon"), F.col("page_id").alias("pos")))


@query("""SELECT page_id, (t = '' OR t LIKE 'text/%') AND t NOT LIKE '%/html' AND NOT starts_with(ltrim(html), '<') AS is_policy FROM (
SELECT page_id, html, lower(trim(split_part(CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'text/plain; charset=utf-8' WHEN 2 THEN 'text/html' ELSE 'image/png' END, ';', 1))) AS t,
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'User-agent: *' ELSE html END AS html FROM pages))""")
def policy_plausible(spark, sf_dir):
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'text/plain; charset=utf-8' WHEN 2 THEN 'text/html' ELSE 'image/png' END")
    body = F.when(F.col("page_id") % 3 == 0, "User-agent: *").otherwise(F.col("html"))
    return pages(spark, sf_dir).select("page_id", text.looks_like_policy(kind, body).alias("is_policy"))


_ERROR = "CASE turn % 3 WHEN 0 THEN 'ReadTimeout' WHEN 1 THEN 'ConnectError' ELSE 'HTTP 503' END"


@query(f"""SELECT conv_id, turn, e AS error, CASE WHEN e = 'ReadTimeout' THEN least(greatest(l, 1), 2) ELSE greatest(l, 1) END::INT AS attempts
FROM (SELECT conv_id, turn, {_ERROR} AS e, (conv_id % 5)::INT AS l FROM conversations)""")
def retry_attempts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ERROR).alias("error"), (F.col("conv_id") % 5).cast("int").alias("limit"))
    return rows.select("conv_id", "turn", "error", attempts_column(F.col("error"), F.col("limit")).alias("attempts"))


@query()
def to_markdown(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", html.to_markdown(F.col("html"), F.lit("text/html")).alias("md"))


@query()
def result_json(spark, sf_dir):
    result = _crawl(spark, sf_dir)
    return spark.createDataFrame([(result.to_json(),)], "json string")


def derived_web(p: DataFrame) -> DataFrame:
    """The pages with one more link each, to the next page of their site; the stored links lead to no stored page.

    The order is made of the keys alone, and all is written once: each wave of a crawl reads it.
    """
    following = F.lead("url").over(Window.partitionBy(urls.host(F.col("url"))).orderBy("page_id"))
    keys = p.select(F.col("page_id").alias("__id"), F.col("url").alias("__url"), following.alias("__next")).where("__next IS NOT NULL")
    keys = keys.groupBy("__id", "__url").agg(F.max("__next").alias("__next"))  # rows that are alike stay as many
    linked = F.when(F.col("__next").isNotNull(), F.concat(F.col("html"), F.lit('<a href="'), F.col("__next"), F.lit('">policy next</a>'))).otherwise(F.col("html"))
    both = p.join(keys, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("url") == F.col("__url")), "left")
    return web.from_pages(saved(both.select("url", linked.alias("html")), "web"))


def _crawl(spark: SparkSession, sf_dir: str):
    """A crawl from the first page of every host, with the settings' own budget."""
    p = pages(spark, sf_dir)
    first = p.groupBy(urls.host(F.col("url")).alias("site")).agg(F.min_by("url", "page_id").alias("url"), F.min("page_id").alias("id"))
    crawler = Crawler("sources array<string>", CRITERION, settings=Settings(max_workers=1024), allowed_domains=[], cache=None)
    return crawler.extract(spark, Web(derived_web(p)), [r["url"] for r in first.orderBy("id").select("url").collect()])


@query()
def crawl_waves(spark, sf_dir):
    """A whole traversal from a seed of every host: the pages in the order of their visit, with their verdicts."""
    result = _crawl(spark, sf_dir)
    verdict = {v.url: v for v in result.verdicts}
    rows = [(i, u, getattr(verdict.get(u), "match", None), getattr(verdict.get(u), "reason", None)) for i, u in enumerate(result.path)]
    return spark.createDataFrame(rows, "visit int, url string, match boolean, reason string")


def next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which links within the boundary would be visited next: extraction, gate, anti-join, first-wins and top-k in one plan."""
    found = links.within(all_links(spark, sf_dir), domains(spark))
    offers = found.select(urls.canonical(F.col("link")).alias("canon"), F.col("link").alias("url"), unit(F.col("link")).alias("score"), F.col("url").alias("source"), "page_id", "pos")
    known = pages(spark, sf_dir).select(urls.canonical(F.col("url")).alias("canon"))
    return frontier.pop(frontier.push(offers, known, ["page_id", "pos"]), 100)
