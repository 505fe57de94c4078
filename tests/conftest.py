import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from eventmill.session import local_session  # noqa: E402

RUN = "2026-06-11T04:35:00+00:00"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def run_page(spark):
    """Records of one page of one source, in page order, as dicts."""
    from pyspark.sql import functions as F

    from eventmill import Options, scrape
    from eventmill.operators.records import dedupe
    from eventmill.plans.scrape import records_of
    from eventmill.schema import ORDER, RECORD_FIELDS
    from eventmill.streaming.incremental import PAGES_SCHEMA

    def run(html, parser, url="https://example.org/events", kind=None, run_at=RUN, opts=None):
        pages = spark.createDataFrame([(1, url, html)], PAGES_SCHEMA)
        registry = spark.createDataFrame(
            [(0, "Example", url, parser, kind)],
            "source_ord int, name string, url string, parser string, kind string",
        )
        found = dedupe(records_of(scrape(pages, registry, run_at, opts or Options(), [parser])))
        rows = found.orderBy(*[F.col(c) for c in ORDER]).select(*RECORD_FIELDS).collect()
        return [row.asDict() for row in rows]

    return run
