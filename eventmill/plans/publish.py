"""Import job (E2): listing records -> enriched, upcoming, sorted, in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from eventmill.operators.details import enrich
from eventmill.operators.records import dedupe, import_batches, incoming, run_summary
from eventmill.plans.scrape import failures, records_of, scrape
from eventmill.schema import Options
from eventmill.session import stored


def upcoming(
    pages: DataFrame,
    registry: DataFrame,
    detail_pages: DataFrame,
    scraped_at: str,
    opts: Options = Options(),
) -> DataFrame:
    """Distinct enriched events from the run date on, with ORDER columns."""
    listed = records_of(scrape(pages, registry, scraped_at, opts))
    return incoming(dedupe(enrich(listed, detail_pages, opts)), scraped_at[:10])


def publish(
    pages: DataFrame,
    registry: DataFrame,
    detail_pages: DataFrame,
    scraped_at: str,
    opts: Options = Options(),
) -> DataFrame:
    """Import request bodies of a whole run."""
    return import_batches(upcoming(pages, registry, detail_pages, scraped_at, opts))


@dataclass(frozen=True)
class Run:
    """What one run gives: request bodies, the events in them, and its failures."""

    registry: DataFrame
    records: DataFrame
    submitted: DataFrame
    batches: DataFrame
    failures: DataFrame
    n_records: int
    n_submitted: int

    def summary(self, results: DataFrame) -> DataFrame:
        """The run's counts, given the responses (imported, skipped) to its batches."""
        return run_summary(self.registry, self.n_records, self.n_submitted, results, self.failures)


def run(
    pages: DataFrame,
    registry: DataFrame,
    detail_pages: DataFrame,
    scraped_at: str,
    opts: Options = Options(),
    on_error: str = "quarantine",
) -> Run:
    """A whole import run. Pages are read once; all parts come from the stored outcome.

    Records are counted while they are written, in the last stage of each write, where a
    task that is run again is counted once. Faulty sources are among the failures, or end
    the run with ``on_error="fail"``.
    """
    read, sent = Observation("records"), Observation("submitted")
    scraped = scrape(pages, registry, scraped_at, opts, on_error=on_error)
    scraped = stored(scraped.observe(read, F.count_if(F.col("error").isNull()).alias("n")))
    found = records_of(scraped)
    submitted = incoming(dedupe(enrich(found, detail_pages, opts)), scraped_at[:10])
    submitted = stored(submitted.observe(sent, F.count(F.lit(1)).alias("n")))
    failed = failures(scraped, pages, registry)
    return Run(registry, found, submitted, import_batches(submitted), failed, read.get["n"], sent.get["n"])
