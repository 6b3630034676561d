from urllib.parse import parse_qsl, urldefrag, urlencode, urlsplit, urlunsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.functions import urls

CASES = [
    "http://Example.COM", "HTTP://a.com/x#frag", "http://a.com/?b=2&a=1&a=0", "http://a.com/p?x", "http://a.com/?q=a+b%20c&z=", "http://u:p@a.com:8080/x/",
    "http://a.com/?a=%zz", "http://a.com//x//", "mailto:me@x.org", "/rel?b=1", "http://a[b]c.com/x", "http://a.com/?a=~*&&b==c", "", "http://a.com/?é=ü",
]


def plain(url):
    parts = urlsplit(urldefrag(url).url)
    pairs = sorted(parse_qsl(parts[3], True))
    return urlunsplit([parts[0].lower(), parts[1].lower(), parts[2] or "/", urlencode(pairs), None])


def keys(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, url string")
    return [r["c"] for r in df.select("i", urls.canonical(F.col("url")).alias("c")).orderBy("i").collect()]


def test_canonical_is_the_library_rule(spark):
    usable = [c for c in CASES if "[" not in c and "%zz" not in c and c and not c.startswith("mailto")]
    assert keys(spark, usable) == [plain(c) for c in usable]
    assert keys(spark, ["http://a[b]c.com/x", None]) == ["http://a[b]c.com/x", None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("abAB.", min_size=1, max_size=5), st.text("ab/~-", max_size=6), st.lists(st.tuples(st.text("ab* +é", max_size=3), st.text("xy~*&=%", max_size=3)), max_size=3)), min_size=5, max_size=20))
def test_canonical_on_random_urls(spark, parts):
    values = [f"http://{h}/{p}?{urlencode(q)}" for h, p, q in parts]
    assert keys(spark, values) == [plain(v) for v in values]


@pytest.mark.parametrize(
    "value, key",
    [("https://www.example.com/x", "example.com"), ("grants.example.com", "example.com"), ("example.com:8080", "example.com"), ("http://a.b.co.uk/", "b.co.uk"), ("localhost", "localhost"),
     ("http://127.0.0.1:80/", "127.0.0.1"), ("", ""), ("not a url", ""), ("http://[bad", ""), ("www.ck", "www.ck"), ("x.y.ck", "x.y.ck"), ("EXAMPLE.ORG", "example.org"), ("com", "com")],
)
def test_domain_key(value, key):
    assert urls.domain_key(value) == key


def test_domain_columns(spark):
    df = spark.createDataFrame([("https://a.example.com/x",), ("http://localhost/",), (None,)], "u string")
    rows = df.select(urls.domain_of(F.col("u")).alias("d"), urls.registrable_domain(urls.host(F.col("u"))).alias("r"), urls.origin(F.col("u")).alias("o")).collect()
    assert [tuple(r) for r in rows] == [("example.com", "example.com", "https://a.example.com"), ("localhost", "", "http://localhost"), (None, None, None)]
    flags = df.select(urls.on_domains(urls.registrable_domain(urls.host(F.col("u"))), ["example.com"]).alias("f")).collect()
    assert [r["f"] for r in flags] == [True, None, None]
    assert urls.split_domains("a.example.com, ,http://b.org/") == {"example.com", "b.org"}
