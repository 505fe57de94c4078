"""Record operators, sinks and repeated runs."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from eventmill import Options, failures, publish, register_extractor, scrape, upcoming
from eventmill.operators import records
from eventmill.operators.details import enrich
from eventmill.operators.extractors import EXTRACTORS, Layout
from eventmill.plans.publish import run
from eventmill.plans.scrape import extract, records_of
from eventmill.schema import ORDER, RECORD_FIELDS
from eventmill.sinks import files
from eventmill.sources.registry import read_registry, save_registry, select_sources, validate_registry
from eventmill.streaming.incremental import (
    PAGES_SCHEMA,
    extract_stream,
    read_failures,
    read_target,
    upsert,
)

RUN = "2026-06-11T04:35:00+00:00"
SOURCE = "source_ord int, name string, url string, parser string, kind string"


@pytest.fixture
def make(spark):
    """Records with the given values, numbered in order."""

    def build(*rows):
        fields = ", ".join(f"{c} string" for c in RECORD_FIELDS)
        data = [
            (0, 0, i, *[{"partner": "A", "kind": "event", **row}.get(c, "") for c in RECORD_FIELDS])
            for i, row in enumerate(rows)
        ]
        return spark.createDataFrame(
            data, f"source_ord long, page_id long, node_id int, {fields}"
        ).repartition(3)

    return build


def titles(df):
    return [r["title"] for r in df.orderBy("node_id").collect()]


def test_dedupe_keeps_the_first_and_is_idempotent(make):
    rows = make(
        {"title": "One", "url": "u"},
        {"title": "ONE", "url": "u"},
        {"title": "One", "url": "v"},
        {"title": "one", "url": "u", "start_date": "2026-01-01"},
        {"title": "one", "url": "u", "partner": "B"},
    )
    once = records.dedupe(rows)
    assert titles(once) == ["One", "One", "one", "one"]
    assert titles(records.dedupe(once)) == titles(once)


@pytest.mark.parametrize("run_day", ["2028-02-28", "2028-02-29", "2028-03-01"])
def test_incoming(make, run_day):
    """Around a leap day, two records a day: events of that day and later ones stay."""
    days = ["2027-12-31", "2028-02-27", "2028-02-28", "2028-02-29", "2028-03-01", "2028-03-02", "2029-01-01"]
    no_days = ["", None, "2029-02-29", "2029-1-1", "soon", "20290101"]
    rows = [{"title": f"{kind} {day}", "start_date": day, "kind": kind} for day in days + no_days for kind in ("event", "announcement")]
    rows += [{"title": "no kind", "start_date": "2030-01-01", "kind": None}]
    assert titles(records.incoming(make(*rows), run_day)) == [f"event {day}" for day in days if day >= run_day]


def test_rank_and_batches_follow_the_whole_order(make):
    # Most records fall on one day.
    days = ["2026-07-05"] * 40 + [f"2026-07-{d:02d}" for d in range(1, 31)]
    rows = make(*[{"title": f"t{i}", "start_date": d} for i, d in enumerate(days)])
    want = [f"t{i}" for _, i in sorted((d, i) for i, d in enumerate(days))]
    ranked = sorted((r["rank"], r["title"]) for r in records.with_rank(rows).collect())
    assert ranked == list(enumerate(want))
    assert [r["title"] for r in records.by_start_date(rows).collect()] == want
    batches = records.import_batches(rows, 32).orderBy("batch_no").collect()
    assert [(b["batch_no"], b["n_records"]) for b in batches] == [(0, 32), (1, 32), (2, 6)]
    bodies = [json.loads(b["body"])["records"] for b in batches]
    assert [r["title"] for body in bodies for r in body] == want
    assert list(bodies[0][0]) == RECORD_FIELDS


def test_board_items(make):
    """Every set of filled-in fields gives its lines and its columns, and no others."""
    facts = {
        "start_date": "2031-11-30", "start_time": "6:15 AM", "end_time": "noon", "location": "Pier 4",
        "description": 'Bring "two"\nboots', "url": "https://q.test/n?a=1", "source_url": "https://q.test/",
    }
    names = list(facts)
    sets = [[n for k, n in enumerate(names) if bits >> k & 1] for bits in range(2 ** len(names))]
    rows = make(*[{"title": f"T{k}", "partner": "Q", **{n: facts[n] for n in own}} for k, own in enumerate(sets)])
    for k, (row, own) in enumerate(zip(records.board_items(rows).orderBy("node_id").collect(), sets, strict=True)):
        has = {n: facts[n] if n in own else "" for n in names}
        lines = ["Partner: Q", f"Date: {has['start_date']}"]
        if span := " - ".join(t for t in (has["start_time"], has["end_time"]) if t):
            lines.append(f"Time: {span}")
        if has["location"]:
            lines.append(f"Location: {has['location']}")
        lines += [f"\n{text}" for text in (has["description"],) if text]
        lines += [f"\nSource page: {text}" for text in (has["source_url"],) if text]
        want = {records.BOARD_COLUMNS["title"]: f"T{k}", records.BOARD_COLUMNS["details"]: "\n".join(lines)}
        if has["start_date"]:
            want[records.BOARD_COLUMNS["date"]] = {"date": has["start_date"]}
        if has["url"]:
            want[records.BOARD_COLUMNS["link"]] = {"url": has["url"], "text": "Event link"}
        assert (row["item_name"], json.loads(row["column_values"])) == (f"T{k}", want)


def test_import_records_fill_in_what_is_missing(spark):
    some = spark.createDataFrame([("t", None, ""), ("u", "x", "news")], "title string, url string, kind string")
    rows = records.to_import(some)
    assert rows.columns == RECORD_FIELDS
    assert [(r["title"], r["url"], r["kind"], r["partner"]) for r in rows.collect()] == [
        ("t", "", "event", ""), ("u", "x", "news", ""),
    ]


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), PAGES_SCHEMA)


def test_one_bad_source_does_not_stop_the_others(spark):
    registry = spark.createDataFrame(
        [
            (0, "Good", "https://g.org", "generic_links", None),
            (1, "Empty", "https://e.org", "generic_links", None),
            (2, "Gone", "https://n.org", "generic_links", None),
            (3, "Odd", "https://o.org", "rss", None),
            (4, "Half", None, "generic_links", None),
        ],
        SOURCE,
    )
    pages = pages_of(
        spark, (1, "https://g.org", "<a href='/x'>Fair May 3</a>"), (2, "https://e.org", None),
        (3, "https://o.org", "<p>"), (4, "https://unknown.org", "<a href='/x'>Fair May 3</a>"),
    )
    scraped = scrape(pages, registry, RUN, layouts=["generic_links"])
    assert [r["partner"] for r in records_of(scraped).collect()] == ["Good"]
    found = {tuple(r) for r in failures(scraped, pages, registry).collect()}
    assert found == {
        ("Empty", "page has no html"), ("Gone", "no page"), ("Odd", "unknown parser: rss"),
        ("Half", "missing url"),
    }
    with pytest.raises(Exception, match="bad source"):
        validate_registry(registry, on_error="fail")[0].collect()
    assert validate_registry(registry.filter("source_ord < 3"), "fail")[0].count() == 3


def test_registry_file(spark, tmp_path):
    path = tmp_path / "sources.json"
    source = {"name": "A b", "url": "https://a.org", "parser": "generic_links"}
    path.write_text(json.dumps({"partners": [source, {**source, "name": "C"}]}, indent=1))
    registry = read_registry(spark, str(path))
    assert [tuple(r) for r in registry.orderBy("source_ord").collect()] == [
        (0, "A b", "https://a.org", "generic_links", None),
        (1, "C", "https://a.org", "generic_links", None),
    ]
    assert [r["name"] for r in select_sources(registry, ["a B"]).collect()] == ["A b"]
    assert select_sources(registry, []).count() == 2
    path.write_text("{}")
    assert read_registry(spark, str(path)).count() == 0


def test_registry_lines_keep_their_order(spark, tmp_path):
    """Written by several tasks, read by several: files split within, one of them empty."""
    path = str(tmp_path / "sources.jsonl")
    rows = [(i, f"N{i}", f"https://s{i}.org", "rss" if i % 3 else None, None) for i in range(500)]
    save_registry(spark.createDataFrame(rows[::-1], SOURCE).repartition(5), path)
    (tmp_path / "sources.jsonl" / "part-99999.json").write_text("")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        found = read_registry(spark, path)
        assert spark.read.json(path).rdd.getNumPartitions() > 4
        assert sorted(tuple(r) for r in found.collect()) == rows
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_registry_file_in_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "sources.yaml"
    path.write_text('partners:\n  - name: "A: b"\n    url: https://a.org\n    parser: rss\n  - name: 7\n')
    rows = read_registry(spark, str(path)).orderBy("source_ord").collect()
    assert [tuple(r) for r in rows] == [
        (0, "A: b", "https://a.org", "rss", None),
        (1, "7", None, None, None),
    ]
    path.write_text("")
    assert read_registry(spark, str(path)).count() == 0


def test_summary(spark, make):
    rows = make({"title": "a", "start_date": "2026-08-01"}, {"title": "b"})
    registry = spark.createDataFrame([(0, "A", "u", "p", None), (1, "B", "v", "p", None)], SOURCE)
    answers = spark.createDataFrame([(3, None), (None, 2)], "imported int, skipped int")
    failed = spark.createDataFrame([("B", "no page")], "partner string, error string")
    sent = records.incoming(rows, "2026-06-11")
    row = records.run_summary(registry, rows, sent, answers, failed).first()
    assert tuple(row) == (2, 2, 1, 3, 2, 1, False)
    nothing = rows.filter("false")
    assert records.run_summary(registry, nothing, nothing, answers, failed).first()["run_failed"]
    assert tuple(records.import_totals(answers.filter("false")).first()) == (0, 0)
    counts = {r["partner"]: r["n_records"] for r in records.source_counts(rows, registry).collect()}
    assert counts == {"A": 2, "B": 0}


def test_enrichment(spark, make):
    rows = make(
        {"title": "told", "url": "https://e.org/p/1", "start_date": "2026-01-01", "location": "Old"},
        {"title": "meta", "url": "https://e.org/p/2", "description": "old"},
        {"title": "silent", "url": "https://e.org/p/3", "description": "old"},
        {"title": "gone", "url": "https://e.org/p/4", "description": "old"},
        {"title": "event", "url": "https://e.org/p/1", "description": "old"},
    )
    parser = F.when(F.col("title") == "event", "squarespace_events").otherwise("wordpress_posts")
    story = """<div class="rte">aside</div><main><div class="article rte"><p>May 3, 2026 to May 4, 2026
      6pm - 8pm</p><div class="rte">inner</div></div><div class="content-main">Last.</div>
      <div class="content-main">Last.</div><img data-src="/late.png"></main>"""
    details = pages_of(
        spark, (1, "https://e.org/p/1", story), (9, "https://e.org/p/1", "<main></main>"),
        (2, "https://e.org/p/2", "<meta content='M' name='Description'><img src='i.png'>"),
        (3, "https://e.org/p/3", "<p>nothing</p>"), (4, "https://e.org/other", story),
    )
    filled = enrich(rows.withColumn("parser", parser), details, Options())
    told, meta, silent, gone, event = filled.orderBy("node_id").collect()
    assert told["description"] == "May 3, 2026 to May 4, 2026 6pm - 8pm inner Last."
    assert (told["start_date"], told["end_date"]) == ("2026-05-03", "2026-05-04")
    assert (told["start_time"], told["end_time"], told["location"]) == ("6PM", "8PM", "Old")
    assert told["image_url"] == "https://e.org/late.png"
    assert (meta["description"], meta["image_url"]) == ("M", "https://e.org/p/i.png")
    assert {r["description"] for r in (silent, gone, event)} == {"old"}


def test_whole_run_with_an_own_layout(spark):
    def every_link(opts):
        return EXTRACTORS["generic_links"].candidates(opts)

    register_extractor("every_link", Layout(every_link, kind="event"))
    try:
        registry = spark.createDataFrame(
            [
                (0, "L", "https://l.org", "every_link", None),
                (1, "B", "https://b.org/blog/", "wordpress_posts", "event"),
            ],
            SOURCE,
        )
        pages = pages_of(
            spark,
            (1, "https://l.org", "<a href='/x'>Fair August 3, 2026</a><a href='/y'>Old May 3, 2020</a>"),
            (2, "https://b.org/blog/", "<h2><a href='p'>Post</a></h2><p>July 20, 2020</p>"),
        )
        details = pages_of(spark, (3, "https://b.org/blog/p", "<main><div class='rte'>July 20, 2026</div>"))
        found = upcoming(pages, registry, details, RUN)
        assert {(r["title"], r["start_date"]) for r in found.collect()} == {
            ("Fair", "2026-08-03"),
            ("Post", "2026-07-20"),
        }
        (batch,) = publish(pages, registry, details, RUN).collect()
        assert [r["title"] for r in json.loads(batch["body"])["records"]] == ["Post", "Fair"]
    finally:
        del EXTRACTORS["every_link"]


def test_extraction_does_not_depend_on_partitioning(spark):
    html = "<nav>{}</nav>".format("".join(f"<a href='/{i}'>Fair {i} May {i}</a>" for i in range(1, 20)))
    registry = spark.createDataFrame([(0, "L", "https://l.org", "generic_links", None)], SOURCE)
    rows = [(i, "https://l.org", html) for i in range(12)]
    results = []
    for parts in (1, 5):
        pages = pages_of(spark, *rows).repartition(parts)
        found = extract(pages, registry, RUN, layouts=["generic_links"])
        results.append(sorted(tuple(r) for r in found.collect()))
    assert results[0] == results[1] and len(results[0]) == 19


def test_files(make, spark, tmp_path):
    rows = make({"title": ' "Quoted", with comma ', "description": "a\\b"}, {"title": "x"})
    out = str(tmp_path / "events.csv")
    files.save(rows, out)
    files.save(rows, out)  # again: replaces
    lines = []
    for part in sorted((tmp_path / "events.csv").glob("part-*")):
        with part.open(newline="") as file:
            lines += list(csv.DictReader(file))
    assert sorted(r["title"] for r in lines) == [' "Quoted", with comma ', "x"]
    assert list(lines[0]) == RECORD_FIELDS and lines[0]["end_date"] == ""
    assert {r["description"] for r in lines} == {"a\\b", ""}
    files.save(rows, str(tmp_path / "e.json"))
    back = spark.read.json(str(tmp_path / "e.json"))
    assert back.count() == 2 and set(back.columns) == set(RECORD_FIELDS)
    assert files.choose_format("x/events") == "csv" and files.choose_format("x.json", "csv") == "csv"
    with pytest.raises(ValueError):
        files.choose_format("events.xml")


@pytest.mark.parametrize("titles", [[], ["one"], ["b", "a", "b", "", 'q"\n,]', "ü"] * 40])
def test_the_parts_of_an_array_are_one_text(make, spark, tmp_path, titles):
    out = tmp_path / "array"
    rows = make({}, *[{"title": t, "start_date": str(i)} for i, t in enumerate(titles)]).filter("start_date != ''")
    rows = rows.repartition(5, "title")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # small parts stay apart
    try:
        files.save_array(rows, str(out))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    parts = sorted(out.glob("part-*"))
    told = json.loads("".join(p.read_text() for p in parts))
    assert [r["title"] for r in told] == titles
    assert all(list(r) == RECORD_FIELDS for r in told)
    assert len(parts) > 1 or len(titles) < 2
    back = files.read_array(spark, str(out))
    assert sorted(map(tuple, back.collect())) == sorted(tuple(r.values()) for r in told)


def test_run_counts_come_with_the_writes(spark):
    pages = pages_of(spark, *[(i, f"https://s.org/{i}", None if i % 3 == 0 else f"<h2><a href='p{i}'>Fair {i}</a></h2><p>July 20, 2032</p>") for i in range(12)])
    sources = [(i, f"S{i}", f"https://s.org/{i}", "wordpress_posts", "event") for i in range(14)]
    registry, none = spark.createDataFrame(sources, SOURCE), pages.limit(0)
    answers = spark.createDataFrame([(5, 3)], "imported int, skipped int")
    done = run(pages.repartition(4), registry, none, RUN)
    assert (done.n_records, done.n_submitted) == (done.records.count(), done.submitted.count()) == (8, 8)
    want = records.run_summary(registry, done.records, done.submitted, answers, done.failures)
    got = done.summary(answers)
    assert got.columns == want.columns and got.collect() == want.collect()
    assert tuple(got.first()) == (14, 8, 8, 5, 3, 6, False)


def test_outboxes_replace_their_own_day_only(make, spark, tmp_path):
    rows, path = make({"title": "a"}, {"title": "b"}), str(tmp_path / "board")
    files.save_board_outbox(rows, path, "2032-01-31", "7")
    files.save_board_outbox(rows, path, "2032-02-01", "7")
    files.save_board_outbox(rows.filter("title = 'a'"), path, "2032-02-01", "7")
    kept = spark.read.parquet(path).groupBy("run_date", "board_id").count().collect()
    assert sorted((str(r["run_date"]), r["count"]) for r in kept) == [("2032-01-31", 2), ("2032-02-01", 1)]


def test_upsert_counts_and_repeats(make, spark, tmp_path):
    target = str(tmp_path / "target")
    first = make({"title": "a"}, {"title": "A"}, {"title": "b"})
    assert tuple(upsert(first, target, 0).first()) == (2, 1)
    second = make({"title": "B"}, {"title": "c"})
    assert tuple(upsert(second, target, 1).first()) == (1, 1)
    assert tuple(upsert(second, target, 1).first()) == (1, 1)  # same batch again
    assert sorted(r["title"] for r in read_target(spark, target).collect()) == ["a", "b", "c"]


def test_upsert_knows_records_with_missing_keys(make, spark, tmp_path):
    target = str(tmp_path / "target")
    rows = make({"title": "a", "start_date": None, "url": None}, {"title": "b", "start_date": "soon"})
    assert tuple(upsert(rows, target, 0).first()) == (2, 0)
    assert tuple(upsert(rows, target, 1).first()) == (0, 2)


def test_runs_with_the_same_batch_number_keep_apart(make, spark, tmp_path):
    target = str(tmp_path / "target")
    assert tuple(upsert(make({"title": "a"}), target, 0, "one").first()) == (1, 0)
    assert tuple(upsert(make({"title": "b"}, {"title": "A"}), target, 0, "two").first()) == (1, 1)
    assert sorted(r["title"] for r in read_target(spark, target).collect()) == ["a", "b"]


def test_a_new_progress_folder_keeps_earlier_records_and_failures(spark, tmp_path):
    registry = spark.createDataFrame(
        [(0, "L", "https://l.org", "generic_links", None), (1, "B", "https://b.org", "rss", None)], SOURCE
    )
    target = str(tmp_path / "out")

    def work(number, *pages):
        landing = str(tmp_path / f"in{number}")
        pages_of(spark, *pages).write.parquet(landing)
        progress = str(tmp_path / f"progress{number}")
        extract_stream(spark, landing, registry, target, progress, RUN).awaitTermination()
        return sorted(r["title"] for r in read_target(spark, target).collect())

    page = "<a href='/x'>{} May 3</a>"
    assert work(1, (1, "https://l.org", page.format("Fair")), (2, "https://l.org", None)) == ["Fair"]
    later = [(3, "https://l.org", page.format("Walk")), (4, "https://u.org", "x"), (5, "https://b.org", "x")]
    assert work(2, *later) == ["Fair", "Walk"]
    failed = {(r.partner, r.url, r.error) for r in read_failures(spark, target).collect()}
    assert failed == {
        ("L", "https://l.org", "page has no html"),
        (None, "https://u.org", "unknown source"),
        ("B", "https://b.org", "unknown parser: rss"),
    }


def test_stream_reads_each_landed_page_once(spark, tmp_path):
    registry = spark.createDataFrame([(0, "L", "https://l.org", "generic_links", None)], SOURCE)
    landing, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def land(page_id, html):
        pages_of(spark, (page_id, "https://l.org", html)).write.mode("append").parquet(landing)
        extract_stream(spark, landing, registry, target, progress, RUN).awaitTermination()
        return sorted((r["batch_id"], r["title"]) for r in read_target(spark, target).collect())

    assert land(1, "<a href='/x'>Fair May 3</a>") == [(0, "Fair")]
    two = "<a href='/x'>FAIR May 3</a><a href='/y'>Walk May 4</a>"
    assert land(2, two) == [(0, "Fair"), (1, "Walk")]


def test_order_columns_are_not_part_of_the_output(spark):
    registry = spark.createDataFrame([(0, "L", "https://l.org", "generic_links", None)], SOURCE)
    found = extract(pages_of(spark, (1, "https://l.org", "<p>")), registry, RUN)
    assert found.columns == RECORD_FIELDS and not set(ORDER) & set(found.columns)


def test_batch_bodies_have_a_kind(make):
    rows = make({"title": "a", "kind": None}, {"title": "b", "kind": ""}, {"title": "c", "kind": "announcement"})
    body = json.loads(records.import_batches(rows).first()["body"])
    assert sorted(r["kind"] for r in body["records"]) == ["announcement", "event", "event"]


def test_a_faulty_source_can_end_the_run(spark):
    registry = spark.createDataFrame([(0, "B", "https://b.org", "rss", None)], SOURCE)
    pages = pages_of(spark, (1, "https://b.org", "x"))
    with pytest.raises(Exception, match="bad source"):
        extract(pages, registry, RUN, on_error="fail").collect()


def test_page_texts_of_details_are_not_moved(spark, make, tmp_path):
    """No exchange, sort or broadcast carries html, with few or many wanted addresses."""
    from eventmill.operators import details

    folder = str(tmp_path / "details")
    pages_of(spark, *[(i, f"https://d.org/{i}", '<div class="rte">Text</div>') for i in range(9)]).write.parquet(folder)
    listed = make({"title": "a", "url": "https://d.org/1"}, {"title": "b", "url": "https://n.org"})
    listed = listed.withColumn("parser", F.lit("wordpress_posts"))
    for most in (details.SENT_ADDRESSES, 0):
        kept, details.SENT_ADDRESSES = details.SENT_ADDRESSES, most
        try:
            filled = enrich(listed, spark.read.parquet(folder))
            assert sorted(r["description"] for r in filled.collect()) == ["", "Text"]
            plan = filled._jdf.queryExecution().executedPlan().toString()
        finally:
            details.SENT_ADDRESSES = kept
        moving = [x for x in plan.split("\n") if any(w in x for w in ("Exchange", "Sort ", "SortMergeJoin"))]
        assert moving and not any("html" in x for x in moving)


def test_a_filter_of_addresses_loses_none_and_keeps_few_others(spark):
    from eventmill.operators import details

    wanted = spark.range(3000).select(F.format_string("https://d.org/%d", "id").alias("url"))
    wanted = wanted.union(spark.createDataFrame([(None,), ("",)], "url string"))
    pages = spark.range(60_000).select("id", F.format_string("https://d.org/%d", "id").alias("url"))
    pages = pages.union(spark.createDataFrame([(-1, ""), (-2, None)], "id long, url string"))
    left = [r.id for r in details.may_be_wanted(pages, wanted, 3002).collect()]
    assert set(range(-1, 3000)) <= set(left) and -2 not in left
    assert len(left) < 3001 + 0.02 * 57_000
    bits, words = details.address_filter(wanted, 10**9)
    assert (bits, len(words)) == (27, 1 << 24)  # never more than 16 MB
    assert details.may_be_wanted(pages.limit(0), wanted, 10).collect() == []


def test_only_pages_that_may_be_wanted_are_read_as_trees(spark, make, monkeypatch):
    from eventmill.operators import details

    read = []
    monkeypatch.setattr(details, "SENT_ADDRESSES", 0)
    real = details._read
    monkeypatch.setattr(details, "_read", lambda pages: read.append(pages) or real(pages))
    texts = [(i, f"https://d.org/{i}", '<div class="rte">Text</div>') for i in range(200)]
    listed = make({"title": "a", "url": "https://d.org/7"}, {"title": "b", "url": "https://n.org"})
    listed = listed.withColumn("parser", F.lit("wordpress_posts"))
    filled = enrich(listed, pages_of(spark, *texts))
    assert sorted(r["description"] for r in filled.collect()) == ["", "Text"]
    assert read[0].count() <= 3
