"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. The landed pages and
the given tables are written once, in as many files as there are cores, before the
clock starts, as they would be found in practice;
every query then runs over all of them, with its result written to nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from eventmill import Options, extract, publish
from eventmill.catalog import queries as catalog
from eventmill.catalog.render import RUN_AT, RUN_OPTIONS, detail_pages
from eventmill.operators import records
from eventmill.plans.scrape import records_of, scrape
from eventmill.schema import LAYOUTS
from eventmill.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, **{"spark.driver.memory": "16g"})
    folder = tempfile.mkdtemp(prefix="eventmill-bench-")

    def landed(name, df):
        # As many files as cores: a table of one small file would be one task.
        df.repartition(cores).write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    for name in ("pages", "orders", "customer", "documents", "events"):
        landed(f"{name}.parquet", spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    given, sf_dir = sf_dir, folder

    pages, registry = catalog.site_tables(spark, sf_dir, *LAYOUTS)
    pages, registry = landed("pages", pages), landed("registry", registry)
    details = landed("details", detail_pages(spark, sf_dir))

    def of_layout(layout):
        chosen = registry.filter(registry.parser == layout)
        return lambda: extract(pages, chosen, RUN_AT, RUN_OPTIONS, [layout])

    def deduped():
        return records.dedupe(records_of(scrape(pages, registry, RUN_AT, RUN_OPTIONS)))

    runs = {
        "extract_all": lambda: extract(pages, registry, RUN_AT, RUN_OPTIONS),
        "extract_worker": lambda: extract(
            pages, registry, RUN_AT, Options.worker(RUN_OPTIONS.base_date)
        ),
        "publish": lambda: publish(pages, registry, details, RUN_AT, RUN_OPTIONS),
        "board_items": lambda: records.board_items(records.incoming(deduped(), RUN_AT[:10])),
        **{f"x_{layout}": of_layout(layout) for layout in LAYOUTS},
    }
    for name in (
        "page_tag_counts", "page_text", "page_links", "links_per_host", "page_headings",
        "long_dates", "post_dates", "normalize_dates", "time_location", "shorten_documents",
        "article_details", "dedupe", "upsert_totals",
    ):
        runs[name] = lambda name=name: catalog.QUERIES[name](spark, sf_dir)

    seconds = {}
    # Starts the Python workers and lets the JVM compile what all queries share.
    for name in ("extract_all", "page_text", "post_dates"):
        runs[name]().write.format("noop").mode("overwrite").save()
    for name, run in runs.items():
        started = time.time()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)

    n_pages, n_bytes = pages.selectExpr("count(*)", "sum(length(html))").first()
    print(
        json.dumps(
            {
                "metric": "seconds for all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(given.rstrip("/")),
                "cores": cores,
                "pages_per_second": round(n_pages / seconds["extract_all"]),
                "mb_per_second": round(n_bytes / 1e6 / seconds["extract_all"], 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
