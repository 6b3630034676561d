"""The wave loop: a best-first traversal as relational steps, one materialised table of outcomes for each wave.

The driver holds what the settings bound (seeds, allowed domains, the pages that the budget admits and the links that were
refused on them); frontier, known URLs, links, host memo and cache are tables. Each wave cuts lineage by writing its outcomes
and its new frontier to the shared folder, and needs two jobs besides: what the driver holds of it, and the refused links.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html, text, urls
from webloom.operators import cache as kv
from webloom.operators import consolidate, frontier, hostmemo, links, outline, recovery, usage
from webloom.providers.base import Provider, get_provider
from webloom.session import local_table, saved
from webloom.settings import Settings
from webloom.sources import web as source
from webloom.sources.http import Live

from .result import AuditLog, CrawlResult, Usage, Verdict

#: Waves after which frontier and known URLs are written anew.
COMPACT = 8


@dataclass
class Web:
    """The tables that a crawl reads; see ``webloom.sources.web``."""

    pages: DataFrame
    redirects: DataFrame | None = None
    candidates: DataFrame | None = None
    robots: DataFrame | None = None
    robots_escalated: DataFrame | None = None
    captures: DataFrame | None = None


@dataclass
class LiveWeb:
    """The live web in the place of the tables: each wave's answers, rules and candidates are asked for and written."""

    live: Live
    known_robots: DataFrame | None = None

    def rules(self, spark: SparkSession, wanted: DataFrame) -> DataFrame:
        """The rules of the origins of the column ``wanted``, each origin asked once."""
        origins = wanted.select(urls.origin(F.col(wanted.columns[0])).alias("origin")).where("origin <> ''").distinct()
        if self.known_robots is not None:
            origins = origins.join(self.known_robots.select("origin"), "origin", "left_anti")
        new = saved(self.live.robots(origins), "robots")
        self.known_robots = new if self.known_robots is None else self.known_robots.union(new)
        return source.policies(self.known_robots)

    def tables(self, wanted: DataFrame, has_routes: bool) -> Web:
        """The answers to the column of URLs as the tables of a web."""
        got = saved(self.live.answers(wanted), "answers")
        pages = got.select(F.col("resolved").alias("url"), "status", "content_type", "body", "error", "failed").dropDuplicates(["url"])
        lost = got.where(F.col("error").isNotNull() | ~recovery.usable(F.col("status"))).select(F.when(F.col("error").isNotNull(), F.col("url")).otherwise(F.col("resolved")).alias("url")).distinct()
        return Web(pages, got.where("url <> resolved").select("url", "resolved"), saved(self.live.candidates(lost), "candidates") if has_routes else None)


def _few(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` is in ``wanted``, a column of a wave's few values: these are sent to the rows, so that a large table isn't moved."""
    return rows.join(F.broadcast(wanted.toDF(key).distinct()), key, "left_semi")


def narrowed(web: Web, wanted: DataFrame) -> Web:
    """The web's tables with the rows alone that the column ``wanted`` of a wave's URLs leads to."""
    redirects = None if web.redirects is None else _few(web.redirects, "url", wanted)
    reached = wanted if redirects is None else wanted.union(redirects.select("resolved"))
    return replace(web, pages=_few(web.pages, "url", reached), redirects=redirects, candidates=None if web.candidates is None else _few(web.candidates, "url", reached))


_DEFAULT = object()


def _schema_text(schema) -> str:
    """All of a schema, so that any change of it, of a limit or a default too, makes old answers another version's."""
    try:
        return json.dumps(outline.json_schema(schema), sort_keys=True)
    except Exception:  # noqa: BLE001 - what can't be rendered is told by its text
        return repr(schema)


class Crawler:
    """Goal-directed traversal and one extraction over the pages that match."""

    def __init__(
        self,
        schema,
        criteria: str,
        *,
        settings: Settings | None = None,
        provider: Provider | None = None,
        cache=_DEFAULT,
        text_filters=None,
        allowed_domains=None,
        allow_seed_redirect_domains=False,
        prefer_seed_domain=None,
        normalize_html=None,
        respect_robots=None,
        robots_overrides=None,
        user_agent=None,
        log_file=None,
    ) -> None:
        """allowed_domains: None for no boundary; an empty list for the seeds' domains alone. cache: a store, None for
        none, or by default a Parquet store at the settings' path."""
        self.schema, self.criteria = schema, criteria
        self.settings = (settings or Settings()).with_(
            normalize=normalize_html, prefer_seed_domain=prefer_seed_domain, user_agent=user_agent, respect_robots=respect_robots, robots_overrides=robots_overrides, log_file=log_file
        )
        self.provider = provider or get_provider(self.settings.provider, self.settings)
        self.allowed = None if allowed_domains is None else urls.domain_keys(allowed_domains)
        self.widen = allow_seed_redirect_domains
        self.text_filters = tuple(text_filters or ())
        self._cache = cache
        self.log = AuditLog(self.settings.log_file)
        self.outline = outline.outline_or_json(schema)
        self.version = kv.version_stamp(normalize=self.settings.normalize, schema_json=_schema_text(schema), criteria=criteria, **{k: getattr(self.provider, k) for k in ("prompt_signature", "model_extract", "model_screen")})

    def extract(self, spark: SparkSession, web: Web | LiveWeb, seeds: str | Iterable[str], max_fetches=None, *, seed_is_content=None) -> CrawlResult:
        s = self.settings
        seeds = list([seeds] if isinstance(seeds, str) else seeds)
        if len(seeds) == 0:
            raise ValueError("a crawl needs a seed")
        direct = s.seed_is_content if seed_is_content is None else seed_is_content
        budget = (s.max_fetches if max_fetches is None else max_fetches) * len(seeds)
        store = kv.ParquetStore(spark, s.llm_cache) if self._cache is _DEFAULT and s.llm_cache else None if self._cache is _DEFAULT else self._cache
        seed_domains = sorted({d for d in (urls.registrable(urls.urlsplit(u).hostname) for u in seeds) if d})
        allowed = None if self.allowed is None else set(self.allowed) | set(urls.domain_keys(seeds))
        overrides = sorted(urls.split_domains(s.robots_overrides))
        configured = recovery.routes(s.fetch_fallbacks)
        policies = None
        if isinstance(web, LiveWeb):
            has_routes = bool(configured)
        else:
            policies = source.policies(web.robots, web.robots_escalated) if s.respect_robots and web.robots is not None else None
            routes = source.routed(web.candidates, web.captures, configured, s.impersonate, sorted(urls.split_domains(s.impersonate_domains)), s.wayback_max_age_days)
            web, has_routes = replace(web, candidates=routes), routes is not None

        # the seeds, each canonical URL once, are a table that the driver makes
        rows = local_table(spark, [(u, i) for i, u in enumerate(seeds)], "url string, pos long").select(urls.canonical(F.col("url")).alias("canon"), "url", "pos").collect()
        first: dict = {}
        for r in rows:
            first.setdefault(r["canon"], (r["canon"], r["url"], float("inf"), r["pos"], None))
        ahead = local_table(spark, list(first.values()), "canon string, url string, score double, seq long, source string")
        known, seed_canon = ahead.select("canon"), list(first)
        landed, memo, refused = set(), None, set()
        path, verdicts, fallbacks, fetched, waves = [], [], {}, 0, []

        while fetched < budget:
            most = min(max(1, s.max_workers), budget - fetched)
            popped = [(r["canon"], r["url"], r["score"], r["seq"], r["source"], i + 1) for i, r in enumerate(frontier.pop(ahead, most).collect())]  # as many as the settings' workers
            batch = local_table(spark, popped, "canon string, url string, score double, seq long, source string, pos int")
            outcomes = saved(self._outcomes(batch, web, known, policies, overrides, memo, store, seed_domains, seeds[0], direct, has_routes), "wave")
            light = sorted(outcomes.select("pos", "canon_asked", "url", "resolved", "canon", "skipped_by_policy", "kind", "via", "verdict", "error", "failed_url", "status_given", "written_off", "usage", "hit").collect())
            if not light:
                break
            if allowed is not None and self.widen:
                allowed |= {d for d in (urls.domain_key(r["resolved"]) for r in light if r["canon_asked"] in seed_canon and not r["skipped_by_policy"] and r["kind"] in ("html", "pdf")) if d}
            kept_pos = []
            for r in light:
                self._tell(r)
                if r["skipped_by_policy"]:
                    continue
                if r["canon"] in landed:
                    self.log(f"    [dedup] {r['url']} → already seen {r['resolved']}")
                else:  # of several that land on one page the first in batch order counts
                    landed.add(r["canon"])
                    kept_pos.append(r["pos"])
                    path.append(r["resolved"])
                    if r["via"]:
                        fallbacks[r["resolved"]] = r["via"]
                    fetched += r["kind"] in ("html", "pdf")
                    if r["verdict"] is not None and r["verdict"]["match"] is not None:
                        verdicts.append(Verdict(r["resolved"], r["verdict"]["match"], r["verdict"]["reason"]))
            kept = outcomes.where(F.col("pos").isin(kept_pos))
            waves.append(outcomes.withColumn("wave", F.lit(len(waves))).withColumn("kept", F.col("pos").isin(kept_pos)))
            if has_routes and s.transport_memo_failures > 0:
                # silence is told of the host that failed, an answer of both ends of a redirect
                silent = recovery.is_silence(F.col("error"))
                spoke = F.when(silent, F.array(urls.domain_of(F.col("failed_url")))).when(F.col("error").isNull(), F.array_distinct(F.array(urls.domain_of(F.col("url")), urls.domain_of(F.col("resolved")))))
                hosts = outcomes.where("NOT skipped_by_policy").select(F.explode(spoke).alias("domain"), silent.alias("silent"))
                memo = saved(hostmemo.merge(memo, hostmemo.memo(hosts.where("domain <> ''"), "domain", F.col("silent"), 0).drop("written_off")), "memo")
            offered = kept.select(F.col("resolved").alias("source"), "pos", F.posexplode("scored").alias("link_pos", "l")).select("source", "pos", "link_pos", F.col("l.url").alias("url"), F.col("l.score").alias("score"))
            if allowed is not None:
                gate = local_table(spark, [(d,) for d in sorted(allowed)], "domain string")
                for r in links.blocked_once(offered, gate, "url").collect():  # links of the wave's pages
                    if r["url"] not in refused:
                        refused.add(r["url"])
                        self.log(f"    [blocked] {r['url']}")
                offered = links.within(offered, gate, "url")
            offered = offered.withColumn("canon", urls.canonical(F.col("url")))
            # what a page was landed on is visited too, whatever address led there
            known = known.union(outcomes.where("NOT skipped_by_policy").select("canon"))
            new = saved(frontier.push(offered, known, ["pos", "link_pos"], len(waves)), "push")
            known = known.union(new.select("canon"))
            if len(light) < most and new.isEmpty():
                break  # all that lay ahead was popped, and nothing came
            gone = outcomes.select(F.explode(F.array("canon_asked", "canon")).alias("canon"))
            ahead = ahead.join(gone, "canon", "left_anti").select(*new.columns).union(new)
            if len(waves) % COMPACT == 0:  # else both are unions of the waves' tables
                ahead, known = saved(ahead, "frontier"), saved(known.distinct(), "known")
        return self._result(spark, waves, store, path, verdicts, fallbacks, fetched, direct)

    def _tell(self, r) -> None:
        """The log lines of one outcome."""
        if r["skipped_by_policy"]:
            return self.log(f"    [robots] {r['url']}")
        if r["written_off"]:
            self.log(f"    [transport-memo] skipping the default transport for {r['url']}" if r["via"] else f"    [transport-memo] no route could read {r['url']}, so its origin was asked")
        if r["error"] and not (r["written_off"] and r["via"]):
            self.log(f"    [transport] {r['error']} on {r['failed_url']}")
        elif r["status_given"] is not None and not 200 <= r["status_given"] < 300:
            self.log(f"    [status] {r['status_given']} on {r['resolved']}")
        if r["via"]:
            self.log(f"    [fallback] {r['resolved']} by {r['via']}")
        for u in r["usage"]:
            tokens = f"tok_in={u['input_tokens']}" + (f"(cached {u['cached_input_tokens']})" if u["cached_input_tokens"] else "") + f" tok_out={u['output_tokens']}"
            self.log(f"    [llm {u['function']}] model={u['model']} in_chars={u['in_chars']} elapsed={u['elapsed']:.2f}s {tokens} {'FAIL:' + u['error'] if u['error'] else 'ok'}")

    def _outcomes(self, batch, web, known, policies, overrides, memo, store, seed_domains, seed, direct, has_routes) -> DataFrame:
        """What each URL of a wave gives: fetched, gated, read, screened, its unknown links scored."""
        s = self.settings
        live = web if isinstance(web, LiveWeb) else None
        if live is not None:
            batch = saved(batch, "batch")
            policies = live.rules(batch.sparkSession, batch.select("url")) if s.respect_robots else None
        rows = batch.withColumn("canon_asked", F.col("canon")).drop("canon")
        own = lambda rows, url: _few(policies, "origin", rows.select(urls.origin(F.col(url))))
        rows = source.allowed(rows, own(rows, "url"), s.user_agent, "url", overrides) if policies is not None else rows.withColumn("allow", F.lit(True))
        off = None
        if memo is not None and has_routes:
            off = memo.where(f"NOT answered AND n_silent >= {s.transport_memo_failures}").select("domain")
        web = live.tables(rows.where("allow").select("url"), has_routes) if live is not None else narrowed(web, batch.select("url"))
        got = source.fetch(rows.where("allow"), web.pages, web.redirects, web.candidates if has_routes else None, off, s.follow_pdf, s.min_recovered_text_chars)
        if live is not None and policies is not None:
            policies = live.rules(batch.sparkSession, web.pages.select("url"))
        if policies is not None:
            got = source.allowed(got, own(got, "resolved"), s.user_agent, "resolved", overrides, "allow")
            got = got.withColumn("allow", F.col("allow") | (urls.canonical(F.col("resolved")) == F.col("canon_asked")))
        refused = rows.where("NOT allow").withColumn("resolved", F.col("url"))
        got = got.unionByName(refused, allowMissingColumns=True).withColumn("skipped_by_policy", ~F.col("allow")).withColumn("canon", urls.canonical(F.col("resolved")))
        readable = F.col("kind").isin("html", "pdf") & ~F.col("skipped_by_policy")
        pdf = F.col("kind") == "pdf"
        md = html.to_markdown(F.col("body"), F.col("content_type")) if s.normalize else F.when(pdf, html.to_markdown(F.col("body"), F.col("content_type"))).otherwise(F.col("body"))
        got = got.withColumn("md", F.when(readable, text.apply_filters(md, self.text_filters)))
        got = got.withColumn("cache_key", kv.page_key(self.version, text.content_hash(F.col("md")), F.col("resolved"), s.prefer_seed_domain, direct))
        if store is not None:
            got = kv.replay(got, store.table(), "page").withColumn("cached", kv.from_value(F.col("value"))).drop("value")
        else:
            got = got.withColumn("cached", kv.from_value(F.lit(None).cast("string")))
        fresh = F.col("cached").isNull() & F.col("md").isNotNull()
        told = lambda url: text.yes_no(links.seed_flag(url, seed_domains)) if s.prefer_seed_domain else None
        if direct:
            screen = F.struct(F.lit(True).alias("match"), F.lit("seed is content").alias("reason"))
        else:
            got = got.withColumn("screened", F.when(fresh, self.provider.screen(F.when(fresh, F.col("md")), self.criteria, F.col("resolved"), told(F.col("resolved")), seed)))
            screen = F.when(F.col("screened.match").isNotNull(), F.struct("screened.match", "screened.reason"))
        replayed = F.struct(F.col("cached.screen_match").alias("match"), F.col("cached.screen_reason").alias("reason"))
        got = got.withColumn("verdict", F.when(F.col("cached").isNotNull(), replayed).when(fresh, screen))
        # the links: not in direct mode, not of a page whose screening failed, not those that are known
        expand = (F.col("kind") == "html") & F.col("verdict").isNotNull() & (F.length("body") > 0)
        found = html.extract_links(F.when(expand, F.col("body")), F.col("resolved")) if not direct else F.array().cast(html.LINKS)
        got = got.withColumn("links", F.when(F.col("cached").isNull(), found))
        cached_links = F.transform("cached.link_scores", lambda x: F.struct(F.lit("").alias("anchor"), x["url"].alias("url")))
        every = got.select("pos", F.posexplode(F.coalesce("links", cached_links)).alias("link_pos", "l"))
        seen = known.union(batch.select("canon"))
        fresh_links = links.unknown(every.select("pos", "link_pos", F.col("l.anchor").alias("anchor"), F.col("l.url").alias("link")), seen)
        fresh_links = fresh_links.groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("link_pos", "anchor", F.col("link").alias("url")))).alias("__fresh"))
        got = got.join(fresh_links, "pos", "left")
        asked = F.transform("__fresh", lambda x: F.struct(x["anchor"].alias("anchor"), x["url"].alias("url")))
        got = got.withColumn("asked", asked)
        flags = links.seed_flags(F.transform("asked", lambda x: x["url"]), seed_domains) if s.prefer_seed_domain else None
        unscored = F.when(F.col("cached").isNull(), F.col("asked"))
        called = self.provider.score(unscored, F.col("md"), self.criteria, flags, seed)
        got = got.withColumn("called", F.when(unscored.isNotNull(), called)).withColumn("given", F.col("called.scores"))
        scored = F.transform(F.arrays_zip("asked", "given"), lambda x: F.struct(x["asked"]["url"].alias("url"), text.clamp(x["given"]).alias("score")))
        old = F.filter("cached.link_scores", lambda x: F.exists("asked", lambda y: y["url"] == x["url"]))
        none = F.array().cast("array<struct<url: string, score: double>>")
        failed = F.col("asked").isNotNull() & F.col("given").isNull() & F.col("cached").isNull()
        got = got.withColumn("scored", F.when(failed, none).otherwise(F.coalesce(old, scored, none)))
        used = lambda name, column: F.when(F.col(column).isNotNull(), F.struct(F.lit(name).alias("function"), f"{column}.usage.*"))
        calls = [used("score_links", "called")] if direct else [used("screen", "screened"), used("score_links", "called")]
        got = got.withColumn("usage", F.array_compact(F.array(*calls)))
        return got.select(
            "pos", "canon_asked", "url", "score", "resolved", "canon", "skipped_by_policy", "kind", "via", "error", F.col("failed").alias("failed_url"), "status_given", F.coalesce("off", F.lit(False)).alias("written_off"),
            "md", "cache_key", "verdict", "scored", "usage", F.col("cached").isNotNull().alias("hit"), failed.alias("failed"),
        )

    def _result(self, spark, waves, store, path, verdicts, fallbacks, fetched, direct) -> CrawlResult:
        s, provider = self.settings, self.provider
        result = CrawlResult(None, "budget_exhausted", fetched, path, verdicts, provider.name, fallbacks_used=fallbacks)
        if not waves:
            return result
        every = waves[0]
        for w in waves[1:]:
            every = every.unionByName(w)
        every = saved(every, "outcomes")
        if store is not None:
            new = every.where("kept AND NOT hit AND NOT failed AND verdict IS NOT NULL").select(F.lit("page").alias("namespace"), F.col("cache_key").alias("key"), kv.to_value(F.col("verdict.match"), F.col("verdict.reason"), F.col("scored")).alias("value"))
            store.upsert(new)
        # every call is billed, of pages too that were dropped afterwards
        events = every.select("wave", "pos", F.explode("usage").alias("u")).select("u.*", F.lit(1).alias("calls"), F.struct("wave", "pos").alias("seq"))
        for r in usage.by_function(events).collect():
            result.usage_by_function[r["function"]] = Usage(**{f: r[f] for f in Usage.__dataclass_fields__})
            result.function_model[r["function"]] = r["model"]

        def bill(function: str, model: str, used: Usage) -> None:
            result.usage_by_function[function] = result.usage_by_function.get(function, Usage()) + used
            result.function_model[function] = model

        matched = every.where("kept AND verdict.match").select("canon", F.col("resolved").alias("url"), "md", "cache_key")
        count = matched.agg(F.count(F.lit(1)).alias("n"), kv.set_fingerprint(F.col("cache_key")).alias("key")).first()
        if not count["n"]:
            return result
        key = f"{self.version}:{s.max_context_tokens}:{int(s.always_summarize)}:{s.tiktoken_encoding}:{count['key']}"
        hit = store.table().where((F.col("namespace") == "extract") & (F.col("key") == key)).first() if store is not None else None
        if hit is not None:
            saved_result = json.loads(hit["value"])
        else:
            try:
                fit = consolidate.fit_pages(matched, consolidate.Fit(provider, self.criteria, s.max_context_tokens, s.always_summarize, self.outline, provider.model_extract, s.tiktoken_encoding, store, self.version))
                for r in fit.usage:
                    bill("summarize", r["model"], Usage(r["calls"], r["input_tokens"], r["cached_input_tokens"], r["output_tokens"]))
                call = provider.extract(fit.text, outline.json_schema(self.schema))
                bill("extract", provider.model_extract, Usage(1, call.input_tokens, call.cached_input_tokens, call.output_tokens))
                if call.error:
                    raise RuntimeError(call.error)
            except Exception as e:  # noqa: BLE001 - a failed stage ends in no data, not in an error
                self.log(f"    ! no extraction: {e!r}")
                return result
            saved_result = {"data": call.value, "content_tokens": fit.content_tokens, "extraction_input_tokens": fit.input_tokens, "summarized": fit.summarized}
            if store is not None and call.value is not None:
                store.upsert(spark.createDataFrame([("extract", key, json.dumps(saved_result))], "namespace string, key string, value string"))
        if saved_result["data"] is not None:
            result.stopped_reason = "match"
        for k, v in saved_result.items():
            setattr(result, k, v)
        return result
