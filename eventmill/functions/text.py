"""Text columns (T1, T2, T7, T16, T19, T20)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \s is ASCII without (?U); the separators 1C-1F count as blank too.
# A single space, which most are, is left as it is; `[^ -~]` only saves looking at letters.
SPACES = r"(?U) [\s\x1c-\x1f]+|[^ -~](?<=[\s\x1c-\x1f])[\s\x1c-\x1f]*"

# Titles that are page furniture, by layout.
STOP_TITLES = {
    "squarespace_events": ["upcoming events", "past events"],
    "heading_date_events": ["past events", "filter events"],
    "squarespace_blog": ["nhcje blog"],
    "shopify_blog_events": ["view all"],
}
STOP_PREFIXES = {"wordpress_posts": ["category "]}

# Calendar link texts inside event blocks. Their first letters have no other
# cases, and stand outside of what is read in any case, which takes longer per character.
CALENDAR_LINKS = r"[Gg](?iU:oogle Calendar\s+ICS)"
VIEW_LINK = r"[Vv](?iU:iew Event\s*)"
VIEW_LINK_ARROW = "[Vv](?iU:iew Event\\s*)→?"
CALENDAR_NOISE = "[GgVv](?i:(?<=G)oogle calendar|(?<=V)iew event)"


def clean_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, F.lit(SPACES), F.lit(" ")))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def or_else(value: Column, other: Column) -> Column:
    """`value` unless it is blank, then `other`; neither is worked out twice,
    as NULLIF would inside a lambda function."""
    return let(value, lambda v: F.when(v != "", v).otherwise(other))


def joined(*parts: Column) -> Column:
    """Non-blank parts with one space between them."""
    return F.concat_ws(" ", *[blank_to_null(p) for p in parts])


def cut(c: Column, limit: Column | int) -> Column:
    """A clean text, ended with dots where it is longer than `limit`."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    short = F.concat(F.rtrim(F.substring(c, F.lit(1), limit - 3)), F.lit("..."))
    return F.when(F.char_length(c) <= limit, c).otherwise(short)


def shorten(c: Column, limit: Column | int) -> Column:
    return cut(clean_text(c), limit)


def is_stop_title(title: Column, layout: str) -> Column:
    low = F.lower(title)
    test = low.isin(STOP_TITLES.get(layout, []) or [""])
    for prefix in STOP_PREFIXES.get(layout, []):
        test = test | low.startswith(prefix)
    return test


def drop_calendar_noise(c: Column, trim_arrow: bool = True) -> Column:
    """A clean text without the texts of calendar links."""
    view = VIEW_LINK_ARROW if trim_arrow else VIEW_LINK
    no_links = F.regexp_replace(c, F.lit(CALENDAR_LINKS), F.lit(""))
    rest = clean_text(F.regexp_replace(no_links, F.lit(view), F.lit("")))
    return F.when(c.rlike(CALENDAR_NOISE), rest).otherwise(c)


def format_time(start: Column, end: Column) -> Column:
    return F.concat_ws(" - ", blank_to_null(start), blank_to_null(end))
