"""Reading a page tree (H3-H18): texts, sections, enclosing elements, links.

A page row carries its tree as arrays, and these expressions look things up in
them by position. Nothing here shuffles, and the work per page is linear in its
size: sections of sibling headings do not overlap, enclosing and first-inside
elements are one lookup, and fixed-length texts look at a bounded stretch of
siblings before anything longer is read.

`n` is always one element of `nodes`. The table forms at the end return one row
per element for queries that want them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions.text import clean_text, let, or_else, shorten
from eventmill.functions.urls import srcset_first
from eventmill.operators.tree import HEADINGS

def nodes() -> Column:
    return F.col("nodes")


def node(node_id: Column) -> Column:
    """The element with this id, NULL for 0."""
    return F.get(nodes(), node_id - 1)


def attr(n: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(n["attrs"], F.lit(name)), F.lit(""))


def has_attr(n: Column, name: str) -> Column:
    return F.map_contains_key(n["attrs"], F.lit(name))


def text(n: Column) -> Column:
    """Text of an element and all below it; pieces come without spare blanks."""
    return F.array_join(F.slice(F.col("runs"), n["run_lo"], n["run_n"]), " ")


def page_text() -> Column:
    return F.array_join(F.col("runs"), " ")


def is_heading(n: Column) -> Column:
    return n["tag"].isin(*HEADINGS)


def _texts(ids: Column, most: int | None = None) -> Column:
    """Texts of the listed elements; with `most`, of that many pieces of each."""

    def one(n: Column) -> Column:
        count = n["run_n"] if most is None else F.least(n["run_n"], F.lit(most))
        return F.array_join(F.slice(F.col("runs"), n["run_lo"], count), " ")

    return F.array_join(F.filter(F.transform(ids, lambda i: one(node(i))), lambda t: t != ""), " ")


def siblings_after(n: Column, most: int | None = None) -> Column:
    """Ids of the element siblings up to the next heading sibling."""
    count = n["sec_end"] - n["kid_pos"] - 1
    if most is not None:
        count = F.least(count, F.lit(most))
    return F.slice(F.col("kids"), n["kid_pos"] + 1, count)


def siblings_before(n: Column) -> Column:
    """Ids of the element siblings back to the previous heading sibling."""
    return F.slice(F.col("kids"), n["sec_lo"], n["kid_pos"] - n["sec_lo"])


def block_text(n: Column, most: int = 12) -> Column:
    return _texts(siblings_after(n, most))


def following_text(n: Column, limit: int) -> Column:
    """First `limit` characters of the section after `n`.

    No piece of text is empty, so `limit` siblings with text, and `limit` pieces of
    each, are always enough: a long run of siblings is only read to the end where the
    near ones turn out to be empty, and a long sibling never is.
    """
    is_all = n["sec_end"] - n["kid_pos"] - 1 <= limit

    def enough(near: Column) -> Column:
        longer = _texts(siblings_after(n), limit)
        return F.when(is_all | (F.char_length(near) >= limit), near).otherwise(longer)

    return F.substring(let(_texts(siblings_after(n, limit), limit), enough), 1, limit)


def previous_text(n: Column, limit: int) -> Column:
    """Nearest earlier siblings until they hold `limit` characters, put in
    document order, then their first `limit` characters."""

    def grow(have: Column, i: Column) -> Column:
        longer = let(
            text(node(i)),
            lambda t: F.when(t == "", have)
            .when(have == "", t)
            .otherwise(F.concat(t, F.lit(" "), have)),
        )
        return F.when(F.char_length(have) >= limit, have).otherwise(longer)

    near_first = F.reverse(siblings_before(n))
    return F.aggregate(near_first, F.lit(""), grow, lambda t: F.substring(t, 1, limit))


def enclosing_event(n: Column) -> Column:
    """Nearest enclosing article, if that one is an event card; else NULL."""
    article = node(n["up"]["article"])
    tokens = F.split(clean_text(attr(article, "class")), " ")
    return F.when(F.array_contains(tokens, "eventlist-event"), article)


def enclosing_card(n: Column) -> Column:
    up = n["up"]
    return node(F.when(up["wrapper"] > 0, up["wrapper"]).otherwise(up["card"]))


def first_link(n: Column) -> Column:
    """Target of the first link inside `n`, NULL if there is none."""
    return F.when(n["first"]["link"] > 0, attr(node(n["first"]["link"]), "href"))


def image_source(n: Column, lazy: bool = False) -> Column:
    """Address in the first image inside `n`, blank if there is none."""

    def source(image: Column) -> Column:
        spare = attr(image, "data-src") if lazy else F.lit("")
        return or_else(attr(image, "src"), or_else(srcset_first(attr(image, "srcset")), spare))

    return F.when(n["first"]["image"] > 0, let(node(n["first"]["image"]), source)).otherwise("")


def first_image(ids: Column, lazy: bool = False) -> Column:
    sources = F.transform(ids, lambda i: image_source(node(i), lazy))
    return F.coalesce(F.get(F.filter(sources, lambda s: s != ""), F.lit(0)), F.lit(""))


def first_link_in(ids: Column) -> Column:
    """Target of the first link at or inside the listed elements, else NULL."""
    targets = F.transform(
        ids,
        lambda i: let(
            node(i),
            lambda n: F.when((n["tag"] == "a") & has_attr(n, "href"), attr(n, "href")).otherwise(
                first_link(n)
            ),
        ),
    )
    return F.get(F.filter(targets, lambda t: t.isNotNull()), F.lit(0))


def card_description(card: Column) -> Column:
    return F.coalesce(text(node(card["first"]["blurb"])), F.lit(""))


def card_title(link: Column, card: Column) -> Column:
    alt = clean_text(attr(node(card["first"]["alt"]), "alt"))
    return or_else(text(link), or_else(clean_text(attr(link, "aria-label")), alt))


def meta(name: str) -> Column:
    """Content of the first meta element that names `name`, blank if none."""

    def says(n: Column) -> Column:
        named = (F.lower(attr(n, "property")) == name) | (F.lower(attr(n, "name")) == name)
        return (n["tag"] == "meta") & named & (attr(n, "content") != "")

    found = F.get(F.filter(nodes(), says), F.lit(0))
    return F.coalesce(attr(found, "content"), F.lit(""))


def nearby(html: Column, n: Column, radius: int) -> Column:
    """Raw page text around the start of `n`."""
    start = F.greatest(n["html_pos"] - radius, F.lit(1))
    return F.substring(html, start, n["html_pos"] + radius - start)


def _main() -> Column:
    """The first main element, NULL without one or where it holds nothing."""
    main = F.get(F.filter(nodes(), lambda n: n["tag"] == "main"), F.lit(0))
    return let(main, lambda m: F.when((m["end_id"] > m["node_id"]) | (m["run_n"] > 0), m))


def article_description(limit: int = 4000) -> Column:
    """Distinct body texts of a detail page, else its meta description."""
    main = _main()

    def body_texts(inside: Column) -> Column:
        # A body inside another body of the searched part belongs to the outer one's text.
        blocks = F.filter(
            nodes(),
            lambda n: (n["tag"] == "div")
            & (n["up"]["body"] <= inside["lo"])
            & (n["node_id"] > inside["lo"])
            & (n["node_id"] <= inside["hi"])
            & attr(n, "class").rlike(r"\b(?:content-main|rte)\b"),
        )
        texts = F.array_distinct(F.transform(blocks, text))
        return F.array_join(F.filter(texts, lambda t: t != ""), " ")

    span = F.struct(
        F.coalesce(main["node_id"], F.lit(0)).alias("lo"),
        F.coalesce(main["end_id"], F.size(nodes())).alias("hi"),
    )
    bodies = let(let(span, body_texts), lambda t: shorten(t, limit))
    return or_else(bodies, meta("description"))


def article_image(lazy: bool = True) -> Column:
    main = _main()
    first = F.get(F.filter(nodes(), lambda n: n["tag"] == "img"), F.lit(0))["node_id"]
    # The image lookup goes by "first inside", which for a page without <main>
    # is the page itself.
    page = F.struct(F.struct(first.alias("image")).alias("first"))
    from_body = F.when(main.isNotNull(), image_source(main, lazy)).otherwise(
        image_source(page, lazy)
    )
    return or_else(meta("og:image:secure_url"), or_else(meta("og:image"), from_body))


# -- one row per element ----------------------------------------------------
def _rows(trees: DataFrame, keep: Callable[[Column], Column], fields) -> DataFrame:
    """Pick elements first and build their texts only then."""
    picked = F.transform(F.filter(nodes(), keep), lambda n: F.struct(*fields(n)))
    carried = [c for c in trees.columns if c not in ("nodes", "runs", "kids", "error", "html")]
    return trees.select(*carried, F.inline(picked))


def elements(trees: DataFrame) -> DataFrame:
    """Every element of every page, without its text."""
    names = ["node_id", "end_id", "parent_id", "sib_ord", "depth", "tag", "attrs"]
    names += ["run_lo", "run_n"]

    def fields(n: Column) -> list[Column]:
        classes = F.filter(F.split(attr(n, "class"), r"(?U)\s+"), lambda t: t != "")
        return [n[c].alias(c) for c in names] + [classes.alias("classes")]

    return _rows(trees, lambda n: n["node_id"] > 0, fields)


def headings(trees: DataFrame) -> DataFrame:
    return _rows(
        trees,
        is_heading,
        lambda n: [
            n["node_id"].alias("node_id"),
            n["tag"].alias("tag"),
            text(n).alias("text"),
            first_link(n).alias("href"),
        ],
    )


def links(trees: DataFrame) -> DataFrame:
    return _rows(
        trees,
        lambda n: (n["tag"] == "a") & has_attr(n, "href"),
        lambda n: [
            n["node_id"].alias("node_id"),
            attr(n, "href").alias("href"),
            text(n).alias("text"),
            n["html_pos"].alias("html_pos"),
        ],
    )


def texts(trees: DataFrame, *tags: str) -> DataFrame:
    """Text of every element with one of these tags."""
    return _rows(
        trees,
        lambda n: n["tag"].isin(*tags),
        lambda n: [
            n["node_id"].alias("node_id"),
            n["tag"].alias("tag"),
            text(n).alias("text"),
        ],
    )


def sections(trees: DataFrame, before: int = 160, after: int = 400) -> DataFrame:
    """Headings with the texts around them: 12-sibling block, before, after."""
    return _rows(
        trees,
        is_heading,
        lambda n: [
            n["node_id"].alias("node_id"),
            n["tag"].alias("tag"),
            text(n).alias("title"),
            block_text(n).alias("block"),
            previous_text(n, before).alias("before"),
            following_text(n, after).alias("after"),
        ],
    )
