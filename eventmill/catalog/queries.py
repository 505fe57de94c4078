"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.catalog import render
from eventmill.catalog.render import RUN_AT, RUN_OPTIONS, table, text, words
from eventmill.functions import dates, places
from eventmill.functions.tables import register_tables
from eventmill.functions.text import format_time, shorten
from eventmill.functions.urls import path_root, resolve_url, url_host, url_parts
from eventmill.operators import details, records, shape
from eventmill.operators.tree import with_tree
from eventmill.plans.scrape import extract, failures, records_of, scrape
from eventmill.schema import LAYOUTS, ORDER, RECORD_FIELDS, Options
from eventmill.session import shared_folder, stored
from eventmill.sinks import delivery, files
from eventmill.sources.archive import read_archive, save_archive
from eventmill.sources.pages import read_pages
from eventmill.plans.publish import run
from eventmill.sources.registry import read_registry, save_registry, select_sources, validate_registry
from eventmill.streaming.incremental import extract_stream, read_failures, read_target, upsert

TODAY = RUN_AT[:10]


# -- pages ------------------------------------------------------------------
def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tree(read_pages(spark, f"{sf_dir}/pages.parquet"))


def page_tag_counts(spark, sf_dir):
    rows = shape.elements(trees(spark, sf_dir))
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


def page_text(spark, sf_dir):
    return trees(spark, sf_dir).select("page_id", shape.page_text().alias("text"))


def page_headings(spark, sf_dir):
    return shape.headings(trees(spark, sf_dir)).select("page_id", "tag", "text")


def page_titles(spark, sf_dir):
    titles = shape.texts(trees(spark, sf_dir), "title")
    return titles.select("page_id", F.col("text").alias("title"))


def page_links(spark, sf_dir):
    found = shape.links(trees(spark, sf_dir)).withColumn("base", url_parts(F.col("url")))
    resolved = found.withColumn("link", resolve_url(F.col("href"), F.col("base")))
    return resolved.groupBy("page_id", "href", "link", path_root(F.col("link")).alias("path")).agg(
        F.count("*").alias("n")
    )


def links_per_host(spark, sf_dir):
    found = shape.links(trees(spark, sf_dir))
    return found.groupBy(url_host(F.col("url")).alias("host")).agg(
        F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets")
    )


def page_meta(spark, sf_dir):
    return with_tree(render.detail_pages(spark, sf_dir, all_orders=True)).select(
        "page_id",
        shape.meta("description").alias("description"),
        shape.meta("og:image").alias("image"),
    )


def article_details(spark, sf_dir):
    found = details.article_details(render.detail_pages(spark, sf_dir, all_orders=True), RUN_OPTIONS)
    page_id = F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("page_id")
    return found.select(page_id, "description", "image_url", "start_date", "location")


def sections(spark, sf_dir):
    pages = with_tree(render.landed(spark, sf_dir, "wordpress_posts"))
    rows = shape.sections(pages, after=400).filter(F.col("title") != "Category News")
    k = F.regexp_extract("title", r"\d+", 0).cast("long").alias("k")
    return rows.select(k, "title", "block", "before", "after")


def elements(spark, sf_dir):
    rows = shape.elements(with_tree(render.landed(spark, sf_dir, "generic_links")))
    return rows.groupBy("page_id").agg(
        F.count("*").alias("n_elements"),
        F.count_if((F.col("tag") == "a") & F.map_contains_key("attrs", F.lit("href"))).alias(
            "n_links"
        ),
        F.max(F.try_element_at("attrs", F.lit("lang"))).alias("lang"),
    )


def elements_sql(spark, sf_dir):
    """The elements once more, by SQL over the landed pages."""
    register_tables(spark)
    return spark.sql(
        """SELECT p.page_id, count(*) AS n_elements,
             count_if(e.tag = 'a' AND map_contains_key(e.attrs, 'href')) AS n_links, max(e.attrs['lang']) AS lang
           FROM {pages} p, LATERAL page_elements(p.html) e GROUP BY p.page_id""",
        pages=render.landed(spark, sf_dir, "generic_links"),
    )


def page_archive(spark, sf_dir):
    """All pages written as web archive files and read back split by split."""
    path = shared_folder(spark)
    save_archive(read_pages(spark, f"{sf_dir}/pages.parquet"), path, split_bytes=4 * 1024 * 1024)
    return read_archive(spark, path).select("page_id", "url", "html")


# -- columns ----------------------------------------------------------------
def order_lines(spark, sf_dir):
    line = text("Order ", F.col("ks"), " opens ", F.col("d1"), " and closes ", F.col("d2"))
    return render.orders(spark, sf_dir).withColumn("line", line)


def long_dates(spark, sf_dir):
    line = F.col("line")
    return order_lines(spark, sf_dir).select(
        "k",
        F.trim(dates.long_date_first(line)).alias("first_date"),
        F.trim(dates.long_date_second(line)).alias("second_date"),
        F.trim(dates.long_date_last(line)).alias("last_date"),
        dates.drop_first_long_date(line).alias("without_first"),
    )


def post_dates(spark, sf_dir):
    found = order_lines(spark, sf_dir).withColumn("found", dates.post_date(F.col("line")))
    return found.select(
        "k",
        F.trim("found").alias("date_text"),
        dates.normalize_date(F.col("found"), RUN_OPTIONS.base_date).alias("post_date"),
        dates.drop_all_dates(F.col("line")).alias("without_dates"),
    )


def long_year_dates(spark, sf_dir):
    """Numeric dates with years of four digits, which only the second profile reads."""
    line = text("Order ", F.col("ks"), " on ", F.date_format("day", "M/d/yyyy"), " or later")
    found = render.orders(spark, sf_dir).select(
        "k",
        dates.post_date(line, any_case=True, long_years=True).alias("long_text"),
        dates.post_date(line).alias("short_text"),
    )
    iso = dates.normalize_date(F.col("long_text"), RUN_OPTIONS.base_date)
    return found.withColumn("long_date", iso)


def month_year(spark, sf_dir):
    line = text("Order ", F.col("ks"), " in ", F.date_format("day", "MMMM yyyy"))
    found = render.orders(spark, sf_dir).select("k", dates.month_year(line).alias("month_text"))
    month = dates.normalize_date(F.col("month_text"), RUN_OPTIONS.base_date)
    return found.withColumn("month_date", month)


def normalize_dates(spark, sf_dir):
    yearless = F.date_format("day", "MMMM d")
    return render.orders(spark, sf_dir).select(
        "k",
        F.col("d1").alias("date_text"),
        dates.normalize_date(F.col("d1"), RUN_OPTIONS.base_date).alias("iso_date"),
        dates.normalize_date(yearless, RUN_OPTIONS.base_date).alias("next_such_day"),
    )


def time_location(spark, sf_dir):
    line = words(F.col("times"), text("Location: ", F.col("place")))
    start, end = places.time_range(F.col("line"))
    lines = render.orders(spark, sf_dir).select("k", line.alias("line"))
    timed = lines.select("*", start.alias("start_time"), end.alias("end_time"))
    return timed.select(
        "k",
        "start_time",
        "end_time",
        format_time(F.col("start_time"), F.col("end_time")).alias("span"),
        places.location(F.col("line")).alias("location"),
        places.location(F.col("line"), to_state=False).alias("location_to_period"),
    )


def shorten_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        shorten(F.col("text"), 700).alias("long_text"),
        shorten(F.col("text"), 400).alias("short_text"),
    )


# -- layouts ----------------------------------------------------------------
def site_tables(spark, sf_dir, *layouts):
    pages = render.landed(spark, sf_dir, *layouts)
    return render.dealt(spark, pages), render.registry_of(spark, sf_dir, pages)


def of_layout(layout: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        pages, registry = site_tables(spark, sf_dir, layout)
        return extract(pages, registry, RUN_AT, RUN_OPTIONS, [layout])

    return query


def of_worker_layout(layout: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark, sf_dir):
        pages, registry = site_tables(spark, sf_dir, layout)
        return extract(pages, registry, RUN_AT, Options.worker(RUN_OPTIONS.base_date), [layout])

    return query


def x_worker_lone_cards(spark, sf_dir):
    pages = render.lone_cards(spark, sf_dir)
    registry = render.registry_of(spark, sf_dir, pages)
    opts = Options.worker(RUN_OPTIONS.base_date)
    return extract(render.dealt(spark, pages), registry, RUN_AT, opts, ["shopify_blog_events"])


def extract_all(spark, sf_dir):
    return extract(*site_tables(spark, sf_dir, *LAYOUTS), RUN_AT, RUN_OPTIONS)


# -- sources ----------------------------------------------------------------
def customer_sources(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("source_ord"), F.col("c_name").alias("name"), "c_mktsegment"
    )


def sources_selected(spark, sf_dir):
    names = ["Customer#000000001", "CUSTOMER#000000007", "customer#000000042"]
    return select_sources(customer_sources(spark, sf_dir), names).select("source_ord", "name")


def registry_invalid(spark, sf_dir):
    segment = F.col("c_mktsegment")
    parser = F.when(segment == "MACHINERY", "rss").when(segment != "HOUSEHOLD", "generic_links")
    has_url = ~segment.isin("BUILDING", "HOUSEHOLD")
    registry = customer_sources(spark, sf_dir).select(
        "source_ord",
        "name",
        F.when(has_url, text("https://example.org/", F.col("name"))).alias("url"),
        parser.alias("parser"),
    )
    return validate_registry(registry)[1].select("source_ord", "error")


def registry_file(spark, sf_dir):
    """Sources written as lines by several tasks and read back in their order; some lack keys."""
    path, seg = f"{shared_folder(spark)}/sources.jsonl", F.col("c_mktsegment")
    sources = customer_sources(spark, sf_dir).select(
        "source_ord",
        "name",
        text("https://c", F.col("source_ord").cast("string"), ".example.org").alias("url"),
        F.when(seg != "MACHINERY", "generic_links").alias("parser"),
        F.when(seg == "BUILDING", "announcement").alias("kind"),
    )
    save_registry(sources, path)
    return read_registry(spark, path)


def _failing_tables(spark, sf_dir):
    """Pages of odd number have no html; every seventh source has an unknown layout."""
    pages, registry = site_tables(spark, sf_dir, *LAYOUTS)
    number = F.regexp_extract("url", r"//p(\d+)", 1).cast("long")
    parser = F.when(number % 7 == 0, "rss").otherwise(F.col("parser"))
    pages = pages.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.col("html")))
    return pages, registry.withColumn("parser", parser)


def _answers(submitted):
    return submitted.groupBy("partner").agg(
        F.count("*").alias("imported"), F.lit(None).cast("long").alias("skipped")
    )


def run_counts(spark, sf_dir):
    """Summary of a whole run some of whose sources fail."""
    pages, registry = _failing_tables(spark, sf_dir)
    done = run(pages, registry, render.detail_pages(spark, sf_dir), RUN_AT, RUN_OPTIONS)
    return done.summary(_answers(done.submitted)).drop("submitted", "imported", "skipped", "scraped")


def run_failures(spark, sf_dir):
    pages, registry = _failing_tables(spark, sf_dir)
    return run(pages, registry, render.detail_pages(spark, sf_dir), RUN_AT, RUN_OPTIONS).failures


def run_failed(spark, sf_dir):
    """A run in which every page is unreadable counts as failed."""
    pages, registry = site_tables(spark, sf_dir, *LAYOUTS)
    pages = pages.withColumn("html", F.lit(None).cast("string"))
    done = run(pages, registry, render.detail_pages(spark, sf_dir), RUN_AT, RUN_OPTIONS)
    return done.summary(_answers(done.submitted))


def source_failures(spark, sf_dir):
    """Sources of unknown layout, without a page, or with an empty one."""
    pages, registry = site_tables(spark, sf_dir, "generic_links")
    facts = (
        render.orders(spark, sf_dir)
        .groupBy("page_id")
        .agg(F.max("price").alias("top"), F.min_by("st", "k").alias("st"))
    )
    blank = (F.col("top") >= 480000) & (F.col("st") == "F")
    pages = (
        pages.join(facts, "page_id")
        .filter(F.col("st") != "O")
        .select("page_id", "url", F.when(~blank, F.col("html")).alias("html"))
    )
    parser = F.when(F.col("st") == "P", "rss").otherwise(F.col("parser"))
    registry = registry.join(facts.withColumnRenamed("page_id", "source_ord"), "source_ord").select(
        "source_ord", "name", "url", parser.alias("parser"), "kind"
    )
    scraped = scrape(pages, registry, RUN_AT, RUN_OPTIONS, ["generic_links"])
    return failures(scraped, pages, registry)


# -- records ----------------------------------------------------------------
def all_scraped(spark, sf_dir):
    return scrape(*site_tables(spark, sf_dir, *LAYOUTS), RUN_AT, RUN_OPTIONS)


def all_upcoming(spark, sf_dir):
    found = records_of(all_scraped(spark, sf_dir))
    return records.incoming(records.dedupe(found), TODAY)


def order_records(spark, sf_dir):
    """Orders as records that repeat each other's titles in another case."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), "c_name")
    orders = render.orders(spark, sf_dir).join(names, "cust")
    verb = F.when(F.col("k") % 2 == 0, "OPEN ").otherwise("Open ")
    fields = {
        "partner": F.col("c_name"),
        "title": text(verb, F.col("st")),
        "start_date": dates.normalize_date(F.col("d1"), RUN_OPTIONS.base_date),
        "url": F.lit("https://example.org/orders"),
        "description": F.col("ks"),
        "kind": F.lit("event"),
    }
    place = [F.lit(0).alias("source_ord"), "page_id", F.col("k").alias("node_id")]
    return orders.select(*place, *[fields.get(c, F.lit("")).alias(c) for c in RECORD_FIELDS])


def dedupe(spark, sf_dir):
    firsts = records.dedupe(order_records(spark, sf_dir))
    return firsts.select("partner", "title", "start_date", F.col("description").alias("found"))


def incoming_sorted(spark, sf_dir):
    return records.to_records(records.by_start_date(all_upcoming(spark, sf_dir)))


def incoming_ranked(spark, sf_dir):
    ranked = records.with_rank(all_upcoming(spark, sf_dir))
    return ranked.select("rank", "title", "start_date", "url")


def import_records(spark, sf_dir):
    pages = render.landed(spark, sf_dir, "squarespace_events")
    names = render.registry_of(spark, sf_dir, pages).select(
        F.col("source_ord").alias("page_id"), F.col("name").alias("partner")
    )
    some = render.orders(spark, sf_dir).join(names, "page_id").select(
        "partner",
        "title",
        text(render.site(F.col("page_id")), "/events/", F.col("ks")).alias("url"),
        F.when(F.col("st") == "F", "announcement").when(F.col("st") == "O", "").alias("kind"),
    )
    return records.to_import(some)


def import_batches(spark, sf_dir):
    return records.import_batches(all_upcoming(spark, sf_dir))


def import_totals(spark, sf_dir):
    answers = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("imported"),
        F.when(F.col("o_orderpriority") != "5-LOW", 1).alias("skipped"),
    )
    return records.import_totals(answers)


def board_items(spark, sf_dir):
    return records.board_items(all_upcoming(spark, sf_dir)).drop(*ORDER)


def event_details(spark, sf_dir):
    found = extract_all(spark, sf_dir)
    return found.select("url", "title", "start_date", records.event_details().alias("details"))


def source_counts(spark, sf_dir):
    pages, registry = site_tables(spark, sf_dir, *LAYOUTS)
    return records.source_counts(extract(pages, registry, RUN_AT, RUN_OPTIONS), registry)


def run_summary(spark, sf_dir):
    pages, registry = site_tables(spark, sf_dir, *LAYOUTS)
    # Read twice: as records and as failures. A table written once serves both.
    folder = shared_folder(spark)
    scrape(pages, registry, RUN_AT, RUN_OPTIONS).write.parquet(folder)
    scraped = spark.read.parquet(folder)
    found = records_of(scraped)
    submitted = records.incoming(records.dedupe(found), TODAY)
    answers = submitted.groupBy("partner").agg(
        F.count("*").alias("imported"), F.lit(None).cast("long").alias("skipped")
    )
    failed = failures(scraped, pages, registry)
    return records.run_summary(registry, found, submitted, answers, failed)


def enriched(spark, sf_dir):
    found = records_of(all_scraped(spark, sf_dir))
    filled = details.enrich(found, render.detail_pages(spark, sf_dir), RUN_OPTIONS)
    return records.to_records(records.dedupe(filled))


# -- sinks and repeated runs ------------------------------------------------
def csv_roundtrip(spark, sf_dir):
    path = shared_folder(spark) + ".csv"
    files.save(extract_all(spark, sf_dir), path)
    columns = ", ".join(f"{c} string" for c in RECORD_FIELDS)
    back = spark.read.schema(columns).options(header=True, escape='"').csv(path)
    return back.fillna("")


def json_roundtrip(spark, sf_dir):
    path = shared_folder(spark)
    files.save(extract_all(spark, sf_dir), path, "json")
    return spark.read.schema(", ".join(f"{c} string" for c in RECORD_FIELDS)).json(path)


def json_array(spark, sf_dir):
    path = shared_folder(spark)
    files.save_array(extract_all(spark, sf_dir), path)
    return files.read_array(spark, path)


def _run_date_as_text(df):
    return df.withColumn("run_date", F.col("run_date").cast("string"))


def import_outbox(spark, sf_dir):
    path = shared_folder(spark)
    files.save_import_outbox(all_upcoming(spark, sf_dir), path, TODAY)
    return _run_date_as_text(spark.read.parquet(path))


def board_outbox(spark, sf_dir):
    path = shared_folder(spark)
    files.save_board_outbox(all_upcoming(spark, sf_dir), path, TODAY, "b1")
    return _run_date_as_text(spark.read.parquet(path))


def import_delivery(spark, sf_dir):
    """A day's request bodies, delivered twice: the second time takes the place of the first."""
    path, sent = shared_folder(spark), stored(all_upcoming(spark, sf_dir))
    delivery.deliver_imports(sent.limit(0), path, TODAY)
    delivery.deliver_imports(sent, path, TODAY)
    return delivery.read_deliveries(spark, path)


def board_delivery(spark, sf_dir):
    path = shared_folder(spark)
    delivery.deliver_board(all_upcoming(spark, sf_dir), path, TODAY, "b1")
    return delivery.read_deliveries(spark, path, TODAY)


def _stream(spark, registry, folder, landing, progress):
    query = extract_stream(
        spark, f"{folder}/{landing}", registry, f"{folder}/records", f"{folder}/{progress}", RUN_AT, RUN_OPTIONS
    )
    query.awaitTermination()


def stream_extract(spark, sf_dir):
    pages, registry = site_tables(spark, sf_dir, "generic_links")
    folder, registry = shared_folder(spark), stored(registry)
    pages.select("page_id", "url", "html").write.parquet(f"{folder}/landing")
    _stream(spark, registry, folder, "landing", "progress")
    return read_target(spark, f"{folder}/records").select(*RECORD_FIELDS)


def stream_restart(spark, sf_dir):
    """Two streams with progress folders of their own fill one target."""
    pages, registry = site_tables(spark, sf_dir, "generic_links")
    folder, registry = shared_folder(spark), stored(registry)
    for part in (0, 1):
        own = pages.filter(F.col("page_id") % 2 == part).select("page_id", "url", "html")
        own.write.parquet(f"{folder}/landing-{part}")
        _stream(spark, registry, folder, f"landing-{part}", f"progress-{part}")
    return read_target(spark, f"{folder}/records").select(*RECORD_FIELDS)


def stream_failures(spark, sf_dir):
    """Landed pages without html, of faulty sources and of no source."""
    pages, registry = site_tables(spark, sf_dir, "generic_links")
    folder, part = shared_folder(spark), F.col("page_id") % 5
    landed = pages.select(
        "page_id",
        F.when(part == 1, text(F.col("url"), "gone")).otherwise(F.col("url")).alias("url"),
        F.when(part != 0, F.col("html")).alias("html"),
    )
    landed.write.parquet(f"{folder}/landing")
    number = F.regexp_extract("url", r"//p(\d+)", 1).cast("long")
    faulty = F.when(number % 5 == 2, "rss").otherwise(F.col("parser"))
    _stream(spark, stored(registry.withColumn("parser", faulty)), folder, "landing", "progress")
    return read_failures(spark, f"{folder}/records").select("partner", "url", "error")


def upsert_totals(spark, sf_dir):
    """Two runs over an event stream; the second brings known records again."""
    folder = shared_folder(spark)
    fields = {"partner": F.col("user_id").cast("string"), "title": F.col("event_type")}
    events = table(spark, sf_dir, "events").select(
        "ts", *[fields.get(c, F.lit("")).alias(c) for c in RECORD_FIELDS]
    )
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    first = upsert(events.filter(F.col("ts") < half), folder, 0)
    second = upsert(events.filter(F.col("ts") >= half), folder, 1)
    return first.select(F.lit("first").alias("run"), "*").unionByName(
        second.select(F.lit("second").alias("run"), "*")
    )


def upsert_parts(spark, sf_dir):
    """The events in ten batches of one run: nine segments, merged, and one more."""
    folder = shared_folder(spark)
    fields = {"partner": F.col("user_id").cast("string"), "title": F.col("event_type")}
    events = stored(
        table(spark, sf_dir, "events").select(
            F.pmod(F.col("event_id"), F.lit(10)).alias("part"), *[fields.get(c, F.lit("")).alias(c) for c in RECORD_FIELDS]
        )
    )
    for part in range(10):
        upsert(events.filter(F.col("part") == part), folder, part)
    kept = read_target(spark, folder)
    return kept.groupBy("batch_id").agg(F.count("*").alias("imported"), F.min("title").alias("first_title"))


def stream_repeats(spark, sf_dir):
    """Pages landed twice, the second time in other files and under other ids, half without html."""
    pages, registry = site_tables(spark, sf_dir, "generic_links")
    folder, registry = shared_folder(spark), stored(registry)
    html = F.when(F.col("page_id") % 2 == 0, F.col("html"))
    pages.select("page_id", "url", html.alias("html")).write.parquet(f"{folder}/landing")
    _stream(spark, registry, folder, "landing", "progress")
    again = pages.select((-F.col("page_id")).alias("page_id"), "url", html.alias("html"))
    again.repartition(3).write.mode("append").parquet(f"{folder}/landing")
    _stream(spark, registry, folder, "landing", "progress")
    records = read_target(spark, f"{folder}/records").select("url", "batch_id", F.lit("").alias("error"))
    failed = read_failures(spark, f"{folder}/records").select("url", "batch_id", "error")
    return records.unionByName(failed)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q
    for q in [
        page_tag_counts,
        page_text,
        page_headings,
        page_titles,
        page_links,
        links_per_host,
        page_meta,
        article_details,
        sections,
        elements,
        elements_sql,
        page_archive,
        long_dates,
        post_dates,
        long_year_dates,
        month_year,
        normalize_dates,
        time_location,
        shorten_documents,
        x_worker_lone_cards,
        extract_all,
        sources_selected,
        registry_invalid,
        source_failures,
        dedupe,
        incoming_sorted,
        incoming_ranked,
        import_records,
        import_batches,
        import_totals,
        import_outbox,
        import_delivery,
        board_items,
        board_outbox,
        board_delivery,
        event_details,
        source_counts,
        run_summary,
        enriched,
        csv_roundtrip,
        json_roundtrip,
        json_array,
        stream_extract,
        stream_restart,
        stream_failures,
        upsert_totals,
        upsert_parts,
        stream_repeats,
        registry_file,
        run_counts,
        run_failures,
        run_failed,
    ]
}
QUERIES.update({f"x_{layout}": of_layout(layout) for layout in LAYOUTS})
# X6 of the second profile has its pages without cards, above.
QUERIES.update({f"xw_{layout}": of_worker_layout(layout) for layout in LAYOUTS[:-1]})
