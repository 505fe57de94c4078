"""The six page layouts (X1-X6) as one Spark plan.

A layout turns the tree of a page into its `candidates`: an array of structs,
one per possible record, worked out inside the page row. ``extract_items``
routes every page to its source's layout with one CASE, explodes the arrays and
reads dates, times, places and links from the texts a candidate carries. Pages
of all layouts share one scan, one tree step and one explode, and no page text
is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions import dates, places
from eventmill.functions.text import (
    blank_to_null,
    clean_text,
    cut,
    drop_calendar_noise,
    is_stop_title,
    joined,
    let,
    or_else,
)
from eventmill.functions.urls import link_parts, resolve_parts, resolve_url, srcset_first, url_path
from eventmill.operators import shape
from eventmill.schema import LAYOUTS, ORDER, RECORD_FIELDS, Options

# What a candidate tells: the words of its dates, the text that names times and
# place, and the description. All come with single blanks only.
CANDIDATE_TEXTS = ["title", "image", "date_text", "end_text", "details", "describe"]


def candidate(
    node_id: Column,
    href: Column | None = None,
    clocks: Column | None = None,
    place: Column | None = None,
    **texts: Column,
) -> Column:
    """One possible record; texts it does not have are blank, no link is NULL.

    A layout that has found the clock times and the place itself gives them as
    `clocks` and `place`; otherwise they are read from `details`.
    """
    nothing = F.lit(None).cast("string")
    return F.struct(
        node_id.alias("node_id"),
        (nothing if href is None else href).alias("href"),
        (nothing if clocks is None else clocks).alias("own_clocks"),
        (nothing if place is None else place).alias("own_place"),
        *[F.coalesce(texts.get(t, F.lit("")), F.lit("")).alias(t) for t in CANDIDATE_TEXTS],
    )


@dataclass(frozen=True)
class Layout:
    """How pages of one layout become records.

    candidates  opts -> array of ``candidate``, without those that cannot be
                records
    kind        record kind where the source names none
    limit       length limit of descriptions
    times       opts -> whether clock times are read
    needs_date  drop candidates whose date words are no real day
    run_date    a candidate without date words happens on the run date;
                without this it is dropped
    details     records are filled from the page that they link to
    """

    candidates: Callable[[Options], Column]
    kind: str = "event"
    limit: int = 700
    times: Callable[[Options], bool] = lambda opts: False
    needs_date: bool = False
    run_date: bool = False
    details: bool = False


def _each(found: Column, raw: Callable[[Column], Column], finish: Callable[[Column], Column]):
    """Per element: gather `raw` texts once, then finish them to a candidate."""
    return F.transform(F.transform(found, raw), finish)


def _text_headings() -> Column:
    return F.filter(shape.nodes(), lambda n: shape.is_heading(n) & (n["run_n"] > 0))


def _stops(title: Column, layout: str, opts: Options) -> Column:
    """Whether a title is page furniture, by layout or for the page's source."""
    found = is_stop_title(title, layout)
    for partner, stop in opts.stop_titles:
        found = found | ((F.col("partner") == partner) & (F.lower(title) == stop.lower()))
    return found


# -- X1 ---------------------------------------------------------------------
EVENT_LIMIT = 700


def _events(opts: Options) -> Column:
    """Headings with the text of their event card, or of their section.

    A card is read once, however many headings it has: what follows carries the
    words found in it and the start of its description, never its whole text.
    """

    def told(block: Column) -> Column:
        start = F.substring(drop_calendar_noise(block, opts.trim_arrow), 1, EVENT_LIMIT + 1)
        return let(dates.long_dates(block, opts.any_case_dates), lambda found: facts_of(block, found, start))

    def facts_of(block: Column, found: Column, start: Column) -> Column:
        first, second = (F.coalesce(F.get(found, F.lit(i)), F.lit("")) for i in (0, 1))
        return F.struct(
            first.alias("date"),
            second.alias("end"),
            places.time_words(block, opts.wide_dashes).alias("clocks"),
            places.location(block, opts.location_to_state).alias("place"),
            start.alias("describe"),
        )

    def of_card(event: Column) -> Column:
        return F.struct(
            let(shape.text(event), told).alias("told"),
            shape.image_source(event, opts.lazy_images).alias("image"),
            shape.first_link(event).alias("link"),
        )

    def of_section(n: Column) -> Column:
        around = shape.siblings_after(n, 12)
        return F.struct(
            let(shape.block_text(n), told).alias("told"),
            shape.first_image(around, opts.lazy_images).alias("image"),
            shape.first_link_in(around).alias("link"),
        )

    def one(n: Column, facts: Column) -> Column:
        title, href, date_text = shape.text(n), shape.first_link(n), facts["told"]["date"]
        if opts.link_from_block:
            href = F.coalesce(blank_to_null(href), facts["link"])
        if opts.date_from_previous:
            earlier = dates.long_date_first(F.trim(shape.previous_text(n, 80)), opts.any_case_dates)
            date_text = or_else(date_text, earlier)
        return candidate(
            n["node_id"],
            href,
            clocks=facts["told"]["clocks"],
            place=facts["told"]["place"],
            title=title,
            image=facts["image"],
            date_text=date_text,
            end_text=facts["told"]["end"],
            describe=facts["told"]["describe"],
        )

    def is_title(n: Column) -> Column:
        def good(title: Column) -> Column:
            fits = F.char_length(title) <= opts.title_limit if opts.title_limit else F.lit(True)
            return fits & ~_stops(title, "squarespace_events", opts)

        return let(shape.text(n), good)

    def card_of(n: Column) -> Column:
        return F.coalesce(shape.enclosing_event(n)["node_id"], F.lit(0))

    def of_page(titled: Column) -> Column:
        cards = F.array_distinct(F.filter(F.transform(titled, card_of), lambda e: e > 0))
        return let(cards, lambda ids: let(
            F.transform(ids, lambda e: let(shape.node(e), of_card)),
            lambda facts: F.transform(titled, lambda n: placed(n, ids, facts)),
        ))

    def placed(n: Column, ids: Column, facts: Column) -> Column:
        at = F.array_position(ids, card_of(n)).cast("int") - 1
        found = F.when(at >= 0, F.get(facts, at)).otherwise(of_section(n))
        return let(found, lambda f: one(n, f))

    return let(F.filter(_text_headings(), is_title), of_page)


# -- X2 ---------------------------------------------------------------------
# Where a long date can be; any case covers both profiles.
MONTHISH = "(?=[JFMASONDjfmasond])(?i:j(?:an|u[nl])|feb|ma[ry]|a(?:pr|ug)|sep|oct|nov|dec)"


def _first_date(n: Column, months: Column, opts: Options) -> Column:
    """The first long date in an element's text.

    `months` are the places of the page's pieces of text that name a month. A date
    begins at most one piece before its month and ends at most two after it, so a few pieces
    around each are read instead of the element's whole text, which all the
    elements around it share.
    """
    end = n["run_lo"] + n["run_n"]

    def near(m: Column) -> Column:
        lo = F.greatest(n["run_lo"], m - 1)
        pieces = F.slice(F.col("runs"), lo, F.least(end, m + 4) - lo)
        head = F.char_length(F.array_join(F.slice(pieces, 1, m + 1 - lo), " "))
        return let(
            F.array_join(pieces, " "),
            lambda words: let(
                dates.long_date_first(words, opts.any_case_dates),
                lambda d: F.when(F.position(d, words) <= head, d).otherwise(""),
            ),
        )

    inside = F.filter(months, lambda m: (m >= n["run_lo"]) & (m < end))
    return F.aggregate(inside, F.lit(""), lambda d, m: F.when(d != "", d).otherwise(near(m)))


def _dated_list(opts: Options) -> Column:
    """Headings under the dated element before them.

    A dated element sets the date for the headings up to the next dated one,
    so each of these stretches is read once.
    """
    tokens = F.filter(
        shape.nodes(),
        lambda n: n["tag"].isin("h2", "h3", "p", "li", "div") & (n["run_n"] > 0),
    )
    places_of_runs = F.sequence(F.lit(1), F.size("runs"))
    months = F.when(
        F.size("runs") > 0,
        F.filter(places_of_runs, lambda r: F.get(F.col("runs"), r - 1).rlike(MONTHISH)),
    )
    dated = F.filter(
        let(
            months,
            lambda ms: F.transform(
                tokens,
                lambda n: F.struct(n["node_id"].alias("at"), _first_date(n, ms, opts).alias("date")),
            ),
        ),
        lambda d: d["date"] != "",
    )

    def one(n: Column, date: Column) -> Column:
        own_image = shape.image_source(n, opts.lazy_images)
        near_image = shape.first_image(shape.siblings_after(n, 12), opts.lazy_images)
        return let(
            shape.block_text(n),
            lambda block: candidate(
                n["node_id"],
                shape.first_link(n),
                title=shape.text(n),
                image=or_else(own_image, near_image),
                date_text=date,
                details=block,
                describe=block,
            ),
        )

    def stretch(d: Column, end: Column) -> Column:
        between = F.slice(shape.nodes(), d["at"] + 1, end - d["at"] - 1)
        listed = F.filter(between, lambda n: n["tag"].isin("h2", "h3") & (n["run_n"] > 0))
        return F.transform(listed, lambda n: one(n, d["date"]))

    page_end = F.size(shape.nodes()) + 1
    under_dates = let(
        dated,
        lambda ds: F.transform(
            ds, lambda d, i: stretch(d, F.coalesce(F.get(ds, i + 1)["at"], page_end))
        ),
    )
    return F.filter(
        F.flatten(under_dates), lambda c: ~_stops(c["title"], "heading_date_events", opts)
    )


# -- X3, X4 -----------------------------------------------------------------
def _post_texts(n: Column, opts: Options, before: int, after: int) -> Column:
    own_image = shape.image_source(n, opts.lazy_images)
    near_image = shape.first_image(shape.siblings_after(n, 12), opts.lazy_images)
    return F.struct(
        n["node_id"].alias("node_id"),
        shape.text(n).alias("title"),
        shape.first_link(n).alias("href"),
        F.trim(shape.previous_text(n, before) if before else F.lit("")).alias("before"),
        F.trim(shape.following_text(n, after)).alias("after"),
        or_else(own_image, near_image).alias("image"),
    )


def _blog(opts: Options) -> Column:
    def finish(t: Column) -> Column:
        near = joined(t["before"], F.trim(F.substring(t["after"], 1, opts.blog_span)))
        return candidate(
            t["node_id"],
            t["href"],
            title=t["title"],
            image=t["image"],
            date_text=dates.post_date(near, opts.any_case_dates, opts.long_numeric_years),
            describe=t["after"],
        )

    found = _each(_text_headings(), lambda n: _post_texts(n, opts, 180, 500), finish)
    return F.filter(found, lambda c: ~_stops(c["title"], "squarespace_blog", opts))


def _posts(opts: Options) -> Column:
    def finish(t: Column) -> Column:
        return candidate(
            t["node_id"],
            t["href"],
            title=t["title"],
            image=t["image"],
            date_text=dates.long_date_last(t["after"], opts.any_case_dates),
            describe=dates.drop_first_long_date(t["after"], opts.any_case_dates),
        )

    found = _each(_text_headings(), lambda n: _post_texts(n, opts, 0, 700), finish)
    return F.filter(found, lambda c: ~_stops(c["title"], "wordpress_posts", opts))


# -- X5 ---------------------------------------------------------------------
def _is_link(n: Column) -> Column:
    return (n["tag"] == "a") & shape.has_attr(n, "href")


def _links(opts: Options) -> Column:
    def raw(n: Column) -> Column:
        return let(shape.text(n), lambda text: texts(n, text))

    def texts(n: Column, text: Column) -> Column:
        context = joined(text, F.trim(shape.following_text(n, 180))) if opts.link_context else text
        return F.struct(
            n["node_id"].alias("node_id"),
            text.alias("text"),
            context.alias("context"),
            shape.attr(n, "href").alias("href"),
            shape.image_source(n, opts.lazy_images).alias("image"),
        )

    def finish(t: Column) -> Column:
        found = dates.post_date(t["context"], opts.any_case_dates, opts.long_numeric_years)
        return let(found, lambda date_text: dated(t, date_text))

    def dated(t: Column, date_text: Column) -> Column:
        text = t["text"]
        if opts.strip_all_dates:
            title = dates.drop_all_dates(text)
        else:
            at = F.position(date_text, text)
            rest = F.concat(
                F.substring(text, F.lit(1), at - 1),
                F.substring(text, at + F.char_length(date_text), F.char_length(text)),
            )
            title = or_else(clean_text(F.when(at > 0, rest)), text)
        return F.when(
            date_text != "",
            candidate(
                t["node_id"],
                t["href"],
                title=title,
                image=t["image"],
                date_text=date_text,
                describe=t["context"],
            ),
        )

    found = F.filter(shape.nodes(), lambda n: _is_link(n) & (n["run_n"] > 0))
    return F.array_compact(_each(found, raw, finish))


# -- X6 ---------------------------------------------------------------------
# Raw-text lookups for a link outside any card.
NEAR_ALT = r"""(?i)\balt=["']([^"']+)["']"""
NEAR_BLURB = r"""(?is)<div\b[^>]*class=["'][^"']*\bcard-description\b[^"']*["'][^>]*>(.*?)</div>"""
NEAR_IMAGE = r"(?i)<img\b[^>]*>"


def _cards(opts: Options) -> Column:
    """The first link to each article under the blog's own path.

    The first link takes the address even where it has no usable title, so
    later links to the same article never make a record.
    """
    base = F.col("base")
    blog = F.concat(F.rtrim(base["path"], F.lit("/")), F.lit("/"))
    to_articles = F.filter(
        F.transform(
            F.filter(shape.nodes(), _is_link),
            lambda n: F.struct(
                resolve_url(shape.attr(n, "href"), base).alias("url"), n["node_id"].alias("at")
            ),
        ),
        lambda link: url_path(link["url"]).startswith(blog),
    )
    firsts = let(
        F.sort_array(to_articles),
        lambda ls: F.filter(ls, lambda x, i: (i == 0) | (F.get(ls, i - 1)["url"] != x["url"])),
    )

    def raw(link: Column) -> Column:
        return let(
            shape.node(link["at"]),
            lambda n: let(shape.enclosing_card(n), lambda card: texts(n, card)),
        )

    def texts(n: Column, card: Column) -> Column:
        title, blurb = shape.card_title(n, card), shape.card_description(card)
        image = F.when(card.isNotNull(), shape.image_source(card, opts.lazy_images)).otherwise(
            shape.image_source(n, opts.lazy_images)
        )
        if opts.nearby_context:
            near, alone = shape.nearby(F.col("html"), n, 1200), card.isNull()
            near_title = clean_text(F.regexp_extract(near, NEAR_ALT, 1))
            title = or_else(title, F.when(alone, near_title))
            blurb = F.when(alone, _near_blurb(near)).otherwise(blurb)
            image = F.when(alone, _near_image(near)).otherwise(image)
        return F.struct(
            n["node_id"].alias("node_id"),
            shape.attr(n, "href").alias("href"),
            F.coalesce(title, F.lit("")).alias("title"),
            blurb.alias("blurb"),
            image.alias("image"),
        )

    def finish(t: Column) -> Column:
        title, blurb = t["title"], t["blurb"]
        words = F.concat_ws(" ", title, blurb)
        found = dates.post_date(words, opts.any_case_dates, opts.long_numeric_years)
        return candidate(
            t["node_id"],
            t["href"],
            title=title,
            image=t["image"],
            date_text=or_else(found, dates.month_year(title)),
            details=blurb,
            describe=or_else(blurb, title),
        )

    return F.filter(
        _each(firsts, raw, finish),
        lambda c: (c["title"] != "") & ~_stops(c["title"], "shopify_blog_events", opts),
    )


def _near_blurb(near: Column) -> Column:
    inner = F.regexp_extract(near, NEAR_BLURB, 1)
    return clean_text(F.regexp_replace(inner, F.lit("<[^>]*>"), F.lit(" ")))


def _near_image(near: Column) -> Column:
    tag = F.regexp_extract(near, NEAR_IMAGE, 0)

    def value(name: str) -> Column:
        return F.regexp_extract(tag, rf"""(?i)(?<![\w-]){name}=["']([^"']+)["']""", 1)

    return or_else(value("src"), or_else(srcset_first(value("srcset")), value("data-src")))


EXTRACTORS: dict[str, Layout] = {
    "squarespace_events": Layout(_events, limit=EVENT_LIMIT, times=lambda opts: True),
    "heading_date_events": Layout(
        _dated_list, times=lambda opts: opts.listing_times, needs_date=True
    ),
    "squarespace_blog": Layout(_blog, kind="announcement", limit=500, details=True),
    "wordpress_posts": Layout(_posts, kind="announcement", limit=500, details=True),
    "generic_links": Layout(_links, limit=400),
    "shopify_blog_events": Layout(_cards, times=lambda opts: True, run_date=True, details=True),
}
assert list(EXTRACTORS) == LAYOUTS


def detail_layouts() -> list[str]:
    """Layouts whose records are filled from the page that they link to."""
    return [name for name, layout in EXTRACTORS.items() if layout.details]


def register_extractor(name: str, layout: Layout) -> None:
    """Add a page layout; sources can then name it as their parser."""
    EXTRACTORS[name] = layout


@lru_cache(maxsize=128)
def _candidates(layout: Layout, opts: Options, application: str) -> Column:
    """A layout's expression. Building it takes thousands of calls to the JVM, so an
    application builds it once for all its jobs with the same options."""
    return layout.candidates(opts)


def _by_layout(values: dict[str, Column], default: Column) -> Column:
    """The value of the row's own layout."""
    routed = None
    for name, value in values.items():
        test = F.col("parser") == name
        routed = F.when(test, value) if routed is None else routed.when(test, value)
    return default if routed is None else routed.otherwise(default)


def extract_items(
    trees: DataFrame, scraped_at: str, opts: Options, layouts: list[str] | None = None
) -> DataFrame:
    """Records, with ORDER, parser and error, of pages that carry their tree.

    `trees` has the source columns of ``plans.scrape.source_pages``. Only the
    layouts in `layouts` (default: all) take part in the plan.
    """
    chosen = {k: EXTRACTORS[k] for k in layouts or EXTRACTORS}

    def those(test: Callable[[Layout], bool]) -> Column:
        names = [k for k, v in chosen.items() if test(v)]
        return F.col("parser").isin(names) if names else F.lit(False)

    application = trees.sparkSession.sparkContext.applicationId
    # A page that could not be read goes through as one row that says so.
    failed = F.col("error").isNotNull()
    listed = F.when(failed, F.array(candidate(F.lit(0)))).otherwise(
        _by_layout({k: _candidates(v, opts, application) for k, v in chosen.items()}, F.lit(None))
    )
    source = ["source_ord", "page_id", "partner", "source_url", "parser", "kind", "base"]
    run_date = those(lambda v: v.run_date)

    def iso(words: str) -> Column:
        # Inside `let`, so that Spark generates this step apart from the last one;
        # together they exceed the size of a Java method.
        return let(F.col(words), lambda c: dates.normalize_date(c, opts.base_date))

    # What several expressions below look at is a column of its own, so that it
    # is worked out once per row.
    items = (
        trees.select(*source, "error", F.inline(listed))
        .filter(failed | (F.col("date_text") != "") | run_date)
        .withColumns(
            {
                "own_date": iso("date_text"),
                "end": iso("end_text"),
                "clocks": F.coalesce(
                    F.col("own_clocks"), places.time_words(F.col("details"), opts.wide_dashes)
                ),
                "link_parts": link_parts(F.col("href")),
                "image_parts": link_parts(F.col("image")),
            }
        )
        .filter(failed | ~those(lambda v: v.needs_date) | (F.col("own_date") != ""))
    )
    lacks = F.col("own_date") if opts.run_date_if_unparsed else F.col("date_text")
    start = F.when(run_date & (lacks == ""), F.lit(scraped_at[:10])).otherwise(F.col("own_date"))
    end = F.col("end")
    timed = those(lambda v: v.times(opts))
    start_time, end_time = places.time_range(F.col("clocks"), opts.wide_dashes)

    def unless_blank(name: str, value: Column) -> Column:
        return F.when(F.col(name) == "", F.lit("")).otherwise(value)

    columns = {
        "start_date": start,
        "end_date": end if opts.keep_equal_end else F.when(end != start, end).otherwise(""),
        "start_time": F.when(timed, start_time).otherwise(F.lit("")),
        "end_time": F.when(timed, end_time).otherwise(F.lit("")),
        "location": F.when(F.col("own_place").isNotNull(), F.col("own_place")).otherwise(
            unless_blank("details", places.location(F.col("details"), opts.location_to_state))
        ),
        "description": cut(
            F.col("describe"),
            _by_layout({k: F.lit(v.limit) for k, v in chosen.items()}, F.lit(700)),
        ),
        "image_url": unless_blank("image", resolve_parts(F.col("image"), F.col("image_parts"), F.col("base"))),
        "url": F.when(F.col("href").isNull(), F.col("source_url")).otherwise(
            resolve_parts(F.col("href"), F.col("link_parts"), F.col("base"))
        ),
        "kind": F.coalesce(
            F.col("kind"),
            _by_layout({k: F.lit(v.kind) for k, v in chosen.items()}, F.lit("event")),
        ),
        "scraped_at": F.lit(scraped_at),
    }
    fields = [columns.get(c, F.col(c)).alias(c) for c in RECORD_FIELDS]
    return items.select(*ORDER, "parser", "error", *fields)
