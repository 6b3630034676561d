import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def site(spark):
    """A web of pages (url -> html, or (status, html)); what isn't there answers 404."""
    from webloom.session import local_table
    from webloom.sources.web import WEB

    def build(pages, errors=None):
        rows = [(u, *(v if isinstance(v, tuple) else (200, v))) for u, v in pages.items()]
        data = [(u, s, "text/html", b, None) for u, s, b in rows] + [(u, None, None, None, e) for u, e in (errors or {}).items()]
        return local_table(spark, data, WEB)

    return build


@pytest.fixture(scope="module")
def small_plans(spark):
    """No compilation and no exchange of partitions for a handful of rows."""
    own = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)
