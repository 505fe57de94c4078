"""Table shapes and job options shared by every module."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


# The record columns, in output order.
RECORD_FIELDS = [
    "partner",
    "title",
    "start_date",
    "end_date",
    "start_time",
    "end_time",
    "location",
    "description",
    "image_url",
    "url",
    "source_url",
    "kind",
    "scraped_at",
]

# The layouts a source can name as its parser.
LAYOUTS = [
    "squarespace_events",
    "heading_date_events",
    "squarespace_blog",
    "wordpress_posts",
    "generic_links",
    "shopify_blog_events",
]

RECORD_SCHEMA = _strings(*RECORD_FIELDS)
REGISTRY_SCHEMA = _strings("name", "url", "parser", "kind")

# Where a record was found. These columns travel with records inside a job and
# give "first in order wins" a meaning on unordered, partitioned data.
ORDER = ["source_ord", "page_id", "node_id"]

# One element of a page. Ids are pre-order positions, 1-based; 0 means "none".
#   end_id          last descendant (node_id itself for a leaf)
#   run_lo, run_n   its text pieces: slice(runs, run_lo, run_n)
#   kid_pos         its place in the page's `kids` array, where the element
#                   children of one parent lie side by side in document order
#   sec_lo, sec_end the stretch of `kids` around it that no heading sibling
#                   interrupts: first place after the previous heading sibling,
#                   and the place where the next one (or the family) ends it
#   up              nearest enclosing article / card wrapper / card / body text
#   first           first descendant link / image / image with alt / blurb
_INT = T.IntegerType()
UP = ["article", "wrapper", "card", "body"]
FIRST = ["link", "image", "alt", "blurb"]
NODE_INTS = [
    "node_id",
    "end_id",
    "parent_id",
    "sib_ord",
    "depth",
    "run_lo",
    "run_n",
    "kid_pos",
    "sec_lo",
    "sec_end",
    "html_pos",
]
NODE = T.StructType(
    [T.StructField(n, _INT) for n in NODE_INTS]
    + [
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("up", T.StructType([T.StructField(n, _INT) for n in UP])),
        T.StructField("first", T.StructType([T.StructField(n, _INT) for n in FIRST])),
    ]
)
PAGE_TREE = T.StructType(
    [
        T.StructField("nodes", T.ArrayType(NODE)),
        T.StructField("runs", T.ArrayType(T.StringType())),
        T.StructField("kids", T.ArrayType(_INT)),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Options:
    """Rules in which the two published profiles of the job differ.

    The defaults are the listing profile; ``Options.worker()`` is the other.
    """

    base_date: str = "2026-01-01"  # dates without a year fall on or after it
    any_case_dates: bool = False
    long_numeric_years: bool = False
    title_limit: int | None = 180
    date_from_previous: bool = True
    keep_equal_end: bool = False
    link_from_block: bool = False
    listing_times: bool = False
    link_context: bool = True
    strip_all_dates: bool = True
    blog_span: int = 260
    run_date_if_unparsed: bool = False
    lazy_images: bool = False
    location_to_state: bool = True
    wide_dashes: bool = True
    trim_arrow: bool = True
    nearby_context: bool = False
    # More titles that are page furniture, as (source name, title) pairs.
    stop_titles: tuple[tuple[str, str], ...] = ()

    @classmethod
    def worker(cls, base_date: str = "2026-01-01") -> Options:
        return replace(
            cls(),
            base_date=base_date,
            any_case_dates=True,
            long_numeric_years=True,
            title_limit=None,
            date_from_previous=False,
            keep_equal_end=True,
            link_from_block=True,
            listing_times=True,
            link_context=False,
            strip_all_dates=False,
            blog_span=500,
            run_date_if_unparsed=True,
            lazy_images=True,
            location_to_state=False,
            wide_dashes=False,
            trim_arrow=False,
            nearby_context=True,
        )
