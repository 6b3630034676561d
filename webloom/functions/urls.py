"""URL keys as Catalyst expressions, and the registrable domain by the Public Suffix List."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: scheme, authority, path, query, fragment
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_WITH_AUTHORITY = ("", "http", "https", "ftp", "file", "ws", "wss", "sftp")

SUFFIX_FILE = os.environ.get("WEBLOOM_SUFFIX_LIST", "/usr/share/publicsuffix/public_suffix_list.dat")
#: Used where no list is installed.
_COMMON = """com org net edu gov int mil info biz io co de fr es it nl uk jp cn in br au ca ch at be se no dk fi pl ru eu us
co.uk org.uk ac.uk gov.uk co.jp ac.jp com.au net.au org.au edu.au gov.au co.nz co.za ac.za com.br co.in nic.in ac.in com.cn edu.cn *.ck !www.ck""".split()


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def _decoded(x: Column) -> Column:
    plain = F.replace(x, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(x), plain)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _canonical_sql(url: str) -> str:
    """``canonical`` of a named column as one SQL text: the plan is the same, but it is made in one call to the JVM."""
    part = lambda i: f"regexp_extract({url}, '{PARTS}', {i})".replace("\\", "\\\\")
    decoded = lambda x: f"coalesce(try_url_decode({x}), replace({x}, '+', ' '))"
    encoded = lambda x: f"replace(replace(url_encode({x}), '%7E', '~'), '*', '%2A')"
    scheme, authority = f"lower({part(1)})", f"lower({part(2)})"
    key, value = decoded("regexp_extract(p, '(?s)^([^=]*)', 1)"), decoded("regexp_extract(p, '(?s)^[^=]*=(.*)$', 1)")
    pairs = f"array_sort(transform(filter(split({part(4)}, '&'), p -> p != ''), p -> named_struct('k', {key}, 'v', {value})))"
    query = f"array_join(transform({pairs}, s -> concat({encoded('s.k')}, '=', {encoded('s.v')})), '&')"
    known = ", ".join(f"'{s}'" for s in _WITH_AUTHORITY)
    slashes = f"CASE WHEN {authority} != '' OR ({scheme} != '' AND {scheme} IN ({known})) THEN concat('//', {authority}) ELSE '' END"
    head = f"CASE WHEN {scheme} = '' THEN '' ELSE concat({scheme}, ':') END"
    return f"concat({head}, {slashes}, CASE WHEN {part(3)} = '' THEN '/' ELSE {part(3)} END, CASE WHEN {query} = '' THEN '' ELSE concat('?', {query}) END)"


def _name(column: Column) -> str | None:
    """The plain name of a column, if it is one."""
    try:
        named = column._jc.node().getClass().getSimpleName() == "UnresolvedAttribute"
        name = str(column)[len("Column<'") : -len("'>")] if named else ""
    except Exception:  # noqa: BLE001 - another kind of session
        return None
    return name if re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*", name) else None


def canonical(url: Column) -> Column:
    """The key under which two spellings of a URL are one page.

    Without fragment, scheme and authority in lower case, an empty path as ``/``, the query's pairs sorted by key
    and value. Ports, user info, trailing slashes and repeated pairs are kept. Null for null.
    """
    if name := _name(url):
        return F.expr(_canonical_sql(name))
    scheme, authority = F.lower(_part(url, 1)), F.lower(_part(url, 2))
    path = F.when(_part(url, 3) == "", F.lit("/")).otherwise(_part(url, 3))
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p != "")
    pairs = F.array_sort(
        F.transform(
            pairs,
            lambda p: F.struct(
                _decoded(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
                _decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
            ),
        )
    )
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    head = F.when(scheme == "", F.lit("")).otherwise(F.concat(scheme, F.lit(":")))
    slashes = F.when((authority != "") | ((scheme != "") & scheme.isin(*_WITH_AUTHORITY)), F.concat(F.lit("//"), authority)).otherwise(F.lit(""))
    return F.concat(head, slashes, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))


def origin(url: Column) -> Column:
    """``scheme://authority`` of an http(s) URL; an empty string for anything else."""
    scheme, authority = F.lower(_part(url, 1)), F.lower(_part(url, 2))
    return F.when(scheme.isin("http", "https") & (authority != ""), F.concat(scheme, F.lit("://"), authority)).otherwise(F.when(url.isNotNull(), F.lit("")))


@functools.lru_cache(maxsize=2)
def suffix_rules(path: str = SUFFIX_FILE) -> tuple[frozenset, frozenset, frozenset]:
    """(plain, wildcard, exception) rules, of the list's registry section."""
    rules = _COMMON
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            text = f.read().partition("// ===BEGIN PRIVATE DOMAINS")[0]
        rules = [line.split()[0] for line in text.splitlines() if line.strip() and not line.startswith("//")]
    ascii_too = set(rules) | {r.encode("idna").decode() for r in rules if not r.isascii() and r[0] not in "*!"}
    return (
        frozenset(r for r in ascii_too if r[0] not in "*!"),
        frozenset(r[2:] for r in ascii_too if r.startswith("*.")),
        frozenset(r[1:] for r in ascii_too if r.startswith("!")),
    )


def registrable(host: str | None) -> str:
    """The public suffix and one more label of a host; empty for IPs and names without a public suffix."""
    plain, wild, exceptions = suffix_rules()
    labels = (host or "").lower().strip(".").split(".")
    for i in range(len(labels)):
        suffix = ".".join(labels[i:])
        if suffix in exceptions:
            return suffix
        if suffix in plain or ".".join(labels[i + 1 :]) in wild:
            return ".".join(labels[i - 1 :]) if i and labels[i - 1] else ""
    return ""


def domain_key(value: str | None) -> str:
    """The boundary key of a URL, host or host:port: its registrable domain, or the bare host where there is none."""
    text = (value or "").strip()
    if not text:
        return ""
    try:
        host = urlsplit(text if "//" in text else f"//{text}").hostname or ""
    except ValueError:
        return ""
    return registrable(host) or ("" if any(c.isspace() for c in host) else host)


def domain_keys(entries: Iterable[str]) -> frozenset[str]:
    return frozenset(k for k in map(domain_key, entries) if k)


def split_domains(value):
    """The keys of a comma-separated list."""
    return domain_keys(value.split(","))


def _over_distinct(function, column: pa.Array) -> pa.Array:
    coded = column.dictionary_encode()
    return pa.array([function(v) if v is not None else None for v in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(T.StringType())
def registrable_domain(host: pa.Array) -> pa.Array:
    """``registrable`` once for each distinct host of a batch."""
    return _over_distinct(registrable, host)


@F.arrow_udf(T.StringType())
def domain_of(value: pa.Array) -> pa.Array:
    """``domain_key`` once for each distinct value of a batch."""
    return _over_distinct(domain_key, value)


def authority(url: Column) -> Column:
    return F.lower(_part(url, 2))


def host(url: Column) -> Column:
    """The host of a URL, without user info and port."""
    return F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")


def on_domains(domain: Column, seeds: Iterable[str]) -> Column:
    """True or false where the registrable domain is known and there are seeds; else null."""
    known = sorted(d for d in seeds if d)
    if not known:
        return F.lit(None).cast("boolean")
    return F.when(F.coalesce(domain, F.lit("")) != "", domain.isin(*known))
