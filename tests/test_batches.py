import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from html_pages import page
from webloom import queries
from webloom.functions import batches, html, text, tokens
from webloom.session import BATCH_BYTES, saved


def test_slices_are_the_rows_in_order():
    seen = []

    @batches.sliced
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        seen.append(sum(len(v or "") for v in x.to_pylist()))
        return y

    x = [None, "a" * 3_000_000, "", *["b" * 1_000] * 5_000]
    y = pa.array([[{"u": str(i)}] if i % 3 else None for i in range(len(x))])
    assert run(pa.array(x), y).equals(y) and len(seen) > 5 and sum(seen) == 8_000_000
    assert max(s for s in seen if s < 3_000_000) <= batches.SLICE_BYTES
    assert len(run(pa.array([], pa.string()), y.slice(0, 0))) == 0


@pytest.mark.parametrize("name", ["split_by_tokens", "extract_links", "unescape", "to_markdown"])
def test_objects_of_a_batch_are_those_of_a_slice(spark, name):
    """A batch of 20 MB: its rows as Python objects would take more."""
    body = pa.array([page("http://a.com/b") + "&amp; word " * 450 for _ in range(4_000)])
    other = pa.array(["text/html" if name == "to_markdown" else "http://a.com/"] * len(body))
    run = {"split_by_tokens": tokens.split_by_tokens(4_000), "extract_links": html.extract_links, "unescape": text.unescape, "to_markdown": html.to_markdown}[name].func
    columns = [body, other] if name in ("extract_links", "to_markdown") else [body]
    small = run(*(c.slice(0, 1) for c in columns))
    tracemalloc.start()
    try:
        out = run(*columns)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(out) == len(body) and out.slice(3_999).to_pylist() == small.to_pylist()
    assert most < 10_000_000


def test_batches_of_saved_steps_are_small(spark):
    @F.arrow_udf(T.LongType())
    def rows(x: pa.Array) -> pa.Array:
        return pa.array([len(x)] * len(x), pa.int64())

    wide = spark.range(0, 8_000, 1, 1).select(rows(F.repeat(F.lit("x"), 2_000)).alias("n"))
    assert saved(wide, "test").agg(F.max("n")).first()[0] < 4_000
    assert spark.conf.get(BATCH_BYTES, None) is None
    assert wide.agg(F.max("n")).first()[0] == 8_000


def test_keys_of_refused_links_are_made_once_a_link(spark):
    """Not for each mention, in a worker beside the one that reads the page."""
    plan = queries.blocked_once(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("domain_of") < plan.index("Aggregate") < plan.index("extract_links")
