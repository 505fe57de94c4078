"""Test pages written from the order table, in each of the six layouts.

One page holds eight neighbouring order keys, so pages stay small whatever the
customers' shares of the orders are. Which variant of a layout an order gets
follows from its priority, status and price. The expected records are worked
out in ``oracle`` from the same tables, without any page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventmill.schema import LAYOUTS, Options

RUN_AT = "2026-06-11T04:35:00+00:00"
RUN_OPTIONS = Options(base_date="2026-07-01")
PER_PAGE = 8
PATHS = {
    "squarespace_events": "/events",
    "heading_date_events": "/all-events",
    "squarespace_blog": "/blog",
    "wordpress_posts": "/category/news/",
    "generic_links": "/Events/",
    "shopify_blog_events": "/blogs/upcoming",
}
WELCOME = (
    "All are welcome; please bring a friend, a chair and something to share with "
    "others at the table."
)
EARLY = (
    "Before the doors open there will be a quiet hour with tea, music and time to "
    "look around the old hall."
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def words(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def only_if(test: Column, *parts: Column | str) -> Column:
    return F.when(test, text(*parts)).otherwise(F.lit(""))


def written(day: Column, priority: Column) -> Column:
    """A day in the style of its order's priority."""
    styles = {
        "1-URGENT": "EEEE, MMMM d, yyyy",
        "2-HIGH": "MMM d, yyyy",
        "3-MEDIUM": "yyyy-MM-dd",
        "4-NOT SPECIFIED": "M/d/yy",
    }
    styled = None
    for name, style in styles.items():
        value = F.date_format(day, style)
        test = priority == name
        styled = F.when(test, value) if styled is None else styled.when(test, value)
    return styled.otherwise(F.date_format(day, "MMMM d"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the words their pages use."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderkey").cast("string").alias("ks"),
        F.floor(F.col("o_orderkey") / PER_PAGE).cast("long").alias("page_id"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("st"),
        F.col("o_orderpriority").alias("pri"),
        F.col("o_totalprice").alias("price"),
        F.to_date("o_orderdate").alias("day"),
    )
    k, st, pri, price = (F.col(c) for c in ("k", "st", "pri", "price"))
    start, end = (8 + k % 4).cast("string"), (1 + k % 5).cast("string")
    dash = (
        F.when(pri == "5-LOW", " ")
        .when(st == "F", " - ")
        .when(st == "O", " to ")
        .otherwise(" – ")
    )
    am = F.when(pri == "2-HIGH", "am").otherwise("AM")
    return raw.select(
        "*",
        F.when(price >= 495000, text("Order ", F.col("ks"), F.repeat(F.lit(" very long"), 20)))
        .otherwise(text("Order ", F.col("ks")))
        .alias("title"),
        F.when(price < 30000, F.rtrim(F.repeat(text("Notes for order ", F.col("ks"), ". "), 50)))
        .otherwise(text("Notes for order ", F.col("ks"), "."))
        .alias("about"),
        written(F.col("day"), pri).alias("d1"),
        written(F.date_add("day", 2), pri).alias("d2"),
        F.when(price < 60000, text(start, ":00 ", am))
        .otherwise(text(start, ":00 ", am, dash, end, ":30 PM"))
        .alias("times"),
        start.alias("start"),
        end.alias("end"),
        F.when((st == "O") & (pri == "5-LOW"), F.lit("Meet at Town Hall"))
        .otherwise(
            text(F.col("ks"), " Orchard Lane, Millbrook, NH", only_if(st == "P", " 03801"))
        )
        .alias("place"),
    )


def _events_item() -> Column:
    k, st, pri = F.col("ks"), F.col("st"), F.col("pri")
    variant = F.col("page_id") % 3
    heading = text(
        "<h1>",
        F.when(pri == "2-HIGH", F.col("title")).otherwise(
            text('<a href="/events/', k, '">', F.col("title"), "</a>")
        ),
        "</h1>",
    )
    d2 = (
        F.when(st == "O", text("<li>", F.col("d1"), "</li>"))
        .when(st == "P", text("<li>", F.col("d2"), "</li>"))
        .otherwise("")
    )
    where = text("<li>", F.col("times"), "</li><li>Location: ", F.col("place"), "</li>")
    listing = text("<ul><li>", F.col("d1"), "</li>", d2, where, "</ul>")
    noise = "<p>Google Calendar  ICS</p><p>View Event →</p>"
    cdn = text('<img src="//cdn.example.org/', k, '.png">')
    sized = text('<p><img srcset="/img/', k, "-1x.png 1x, /img/", k, '-2x.png 2x"></p>')
    image = F.when(st == "F", text("<p>", cdn, "</p>")).when(st == "O", sized).otherwise(cdn)
    rest = text("<p>", F.col("about"), "</p>", noise, image, "<p>", WELCOME, "</p>")
    early = only_if(st == "P", "<p>", EARLY, "</p>")
    return (
        F.when(variant == 0, text(heading, listing, rest))
        .when(
            variant == 1,
            text('<article class="eventlist-event x">', heading, listing, rest, "</article>"),
        )
        .otherwise(
            text(
                "<div>", early, "<p>", F.col("d1"), "</p>", heading, "<ul>", where, "</ul>",
                rest, "</div>",
            )
        )
    )


def _dated_item() -> Column:
    k, st = F.col("ks"), F.col("st")
    date = F.when(F.col("price") >= 480000, "February 30, 2026").otherwise(F.col("d1"))
    return text(
        "<p>", date, "</p><h3>",
        only_if(st == "F", '<img src="h', k, '.png">'),
        '<a href="https://forms.example.org/', k, '">', F.col("title"), "</a></h3>",
        "<p>Meeting Place: Hall ", k, " | 17 Orchard Lane, Millbrook, NH. ", F.col("about"),
        only_if(st == "O", '<img src="/i/', k, '.png">'), "</p>",
        only_if(st == "P", "<h3>More on order ", k, "</h3><p>Second part ", k, "</p>"),
    )


def _blog_item() -> Column:
    k, st = F.col("ks"), F.col("st")
    date = text("<p>", F.col("d1"), "</p>")
    return text(
        "<section>", only_if(st != "P", date),
        '<h2><a href="post/', k, '">', F.col("title"), "</a></h2><p>", F.col("about"),
        only_if(st == "F", '<img src="../k', k, '.jpg">'), "</p>",
        only_if(st == "P", date), only_if(st == "O", "<p>Updated May 4, 2003</p>"),
        "</section>",
    )


def _post_item() -> Column:
    k = F.col("ks")
    return text(
        '<h2><a href="../../news/', k, '">', F.col("title"), "</a></h2><p>", F.col("about"),
        only_if(F.col("st") == "F", '<img data-src="x.png" src="http://img.example.org/', k, '.png">'),
        "</p><ul><li>Staff of May 1, 1990</li><li>", F.col("d1"), "</li></ul>",
    )


def _link_item() -> Column:
    k, st, price = F.col("ks"), F.col("st"), F.col("price")
    name = F.when(price < 30000, F.col("d1")).otherwise(text(F.col("title"), " ", F.col("d1")))
    image = only_if(F.col("pri") == "1-URGENT", '<img src="/t/', k, '.png">')
    copy = text('<p><a href="./e/', k, '">ORDER ', k, " ", F.col("d1"), "</a></p>")
    return F.when(
        st == "P",
        text(
            '<p><a href="?id=', k, '">', image, F.col("title"), "</a> <span>on ", F.col("d1"),
            "</span></p>",
        ),
    ).otherwise(
        text(
            '<p><a href="e/', k, '">', image, name, "</a></p>",
            only_if((price >= 100000) & (price < 150000), copy),
        )
    )


def card_title() -> Column:
    pri = F.col("pri")
    return (
        F.when(pri == "1-URGENT", text("Order ", F.col("ks"), ", ", F.date_format("day", "MMMM d")))
        .when(pri == "2-HIGH", text("Order ", F.col("ks"), " ", F.date_format("day", "MMMM yyyy")))
        .otherwise(text("Order ", F.col("ks")))
    )


def card_blurb() -> Column:
    pri = F.col("pri")
    timed = text(
        "From ", F.col("start"), ":00 AM to ", F.col("end"), ":30 PM. Location: Room ",
        F.col("ks"), ". ", F.col("d1"),
    )
    return (
        F.when(pri.isin("3-MEDIUM", "4-NOT SPECIFIED"), timed)
        .when(pri == "5-LOW", F.col("about"))
        .otherwise("")
    )


def _card_item() -> Column:
    st, title = F.col("st"), card_title()
    href = text('<a href="/blogs/upcoming/', F.col("ks"), '"')
    blurb = text('<div class="card-description muted">', card_blurb(), "</div>")
    image = text('<img src="//cdn.example.org/', F.col("ks"), '.png" alt="', title, '">')
    inside = text('<div class="card-content"><h3>', href, ">", title, "</a></h3>", blurb, "</div>")
    first = F.when(st == "F", text(href, ' aria-label="', title, '"></a>')).otherwise(
        text(href, "></a>")
    )
    return F.when(
        st == "P", text('<section class="card">', href, ">", title, "</a>", blurb, "</section>")
    ).otherwise(
        text('<div class="article-card-wrapper card-wrapper">', image, first, inside, "</div>")
    )


# What stands on a page of each layout before its items.
HEADS = {
    "squarespace_events": "<h2>Upcoming Events</h2>",
    "heading_date_events": "<h2>Filter Events</h2>",
    "squarespace_blog": "<h1>NHCJE Blog</h1>",
    "wordpress_posts": "<h1>Category News</h1>",
    "generic_links": "<nav><a href='/'>Home</a></nav>",
    "shopify_blog_events": '<a href="/blogs/upcoming/none"></a>'
    '<a href="/blogs/upcoming/none">Order none</a><a href="/blogs/upcoming/all">View all</a>',
}
ITEMS = {
    "squarespace_events": _events_item,
    "heading_date_events": _dated_item,
    "squarespace_blog": _blog_item,
    "wordpress_posts": _post_item,
    "generic_links": _link_item,
    "shopify_blog_events": _card_item,
}


def layout_of_page() -> Column:
    """Layout of a page where all of them take part."""
    return F.element_at(F.array(*[F.lit(n) for n in LAYOUTS]), (F.col("page_id") % 6 + 1).cast("int"))


def site(page_id: Column) -> Column:
    return text("https://p", page_id.cast("string"), ".example.org")


def _choose(layout: Column, values: dict[str, Column]) -> Column:
    if len(values) == 1:
        return next(iter(values.values()))
    chosen = None
    for name, value in values.items():
        chosen = F.when(layout == name, value) if chosen is None else chosen.when(layout == name, value)
    return chosen


def landed(spark: SparkSession, sf_dir: str, *layouts: str) -> DataFrame:
    """Pages (page_id, url, html, parser, cust) with all orders on them.

    One layout: all pages have it. More: pages take turns.
    """
    layout = layout_of_page() if len(layouts) > 1 else F.lit(layouts[0])
    items = orders(spark, sf_dir).select(
        "page_id", "k", "cust", _choose(layout, {n: ITEMS[n]() for n in layouts}).alias("item")
    )
    # Eight keys to a page at most, so the lists are bounded.
    pages = items.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("k", "item"))).alias("items"),
        F.min_by("cust", "k").alias("cust"),
    )
    body = F.array_join(F.transform("items", lambda i: i["item"]), "\n")
    body = F.when(
        (layout == "heading_date_events") & (F.col("page_id") % 2 == 1),
        text('<div class="all">', body, "</div>"),
    ).otherwise(body)
    head = _choose(layout, {n: F.lit(HEADS[n]) for n in layouts})
    path = _choose(layout, {n: F.lit(PATHS[n]) for n in layouts})
    return pages.select(
        "page_id",
        text(site(F.col("page_id")), path).alias("url"),
        text(
            "<!DOCTYPE html><html lang='en'><head><title>Page</title><style>p{}</style></head><body>",
            head, body, "<script>var may=\"<p>May 1, 2026</p>\";</script></body></html>",
        ).alias("html"),
        layout.alias("parser"),
        "cust",
    )


def dealt(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages in all partitions of the session's shuffles, by address.

    Reading a page costs far more than its bytes tell, by which Spark would put many
    partitions into one task; a join by address finds them in their places.
    """
    return pages.repartition(4 * spark.sparkContext.defaultParallelism, "url")


def registry_of(spark: SparkSession, sf_dir: str, pages: DataFrame) -> DataFrame:
    """One source per page, named after the customer of its first order."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), "c_name")
    return pages.join(names, "cust").select(
        F.col("page_id").alias("source_ord"),
        F.col("c_name").alias("name"),
        "url",
        "parser",
        F.lit(None).cast("string").alias("kind"),
    )


def lone_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card links that stand in no card, far enough apart to see only their own
    image in the raw text around them."""
    gap = "<!--" + "." * 1300 + "-->"
    items = orders(spark, sf_dir).select(
        "page_id", "k", "cust",
        text(
            gap, '<p><img data-src="//cdn.example.org/', F.col("ks"), '.png" alt="', card_title(),
            '"><a href="/blogs/upcoming/', F.col("ks"), '"></a></p><div class="card-description">',
            F.when(F.col("pri") == "5-LOW", "").otherwise(card_blurb()), "</div>",
        ).alias("item"),
    )
    pages = items.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("k", "item"))).alias("items"),
        F.min_by("cust", "k").alias("cust"),
    )
    return pages.select(
        "page_id",
        text(site(F.col("page_id")), "/blogs/upcoming").alias("url"),
        F.array_join(F.transform("items", lambda i: i["item"]), "\n").alias("html"),
        F.lit("shopify_blog_events").alias("parser"),
        "cust",
    )


# Where the listing of each layout says an order's own page is.
DETAIL_PATHS = {
    "squarespace_blog": "/post/",
    "wordpress_posts": "/news/",
    "shopify_blog_events": "/blogs/upcoming/",
}


def detail_pages(spark: SparkSession, sf_dir: str, all_orders: bool = False) -> DataFrame:
    """The own page of every order, at the address its listing page names if pages
    of all layouts take turns; unless `all_orders`, those of low priority have none."""
    o, k, st = orders(spark, sf_dir), F.col("ks"), F.col("st")
    layout = layout_of_page()
    path = F.lit("/none/")
    for name, value in DETAIL_PATHS.items():
        path = F.when(layout == name, value).otherwise(path)
    story = text(
        '<div class="page-width rte">Join us on ', F.date_format("day", "MMMM d, yyyy"),
        " 7:00 PM - 9:00 PM. Location: Barn ", k, ".</div>",
    )
    meta = text(
        '<meta name="description" content="Meta of order ', k,
        '"><meta content="/og/', k, '.png" property="og:image">',
    )
    second = text('<div class="content-main">Second ', k, "</div>")
    told = F.when(st == "F", text(story, story, second)).otherwise("<p>Bare</p>")
    # Bodies count from the main element on: one around it is none of them, and an
    # empty main element leaves the whole page.
    urgent, empty = F.col("pri") == "1-URGENT", (F.col("pri") == "2-HIGH") & (st == "F")
    body = (
        F.when(empty, text("<main></main>", told))
        .when(urgent, text("<div class='rte'>No<main>", told, "</main></div>"))
        .otherwise(text("<div class='rte'>No</div><main>", told, "</main>"))
    )
    if not all_orders:
        o = o.filter(F.col("pri") != "5-LOW")
    return o.select(
        F.col("k").alias("page_id"),
        text(site(F.col("page_id")), path, k).alias("url"),
        text(
            "<html><head>", F.when(st != "P", meta).otherwise(""), "</head><body>", body, "</body></html>",
        ).alias("html"),
    )
