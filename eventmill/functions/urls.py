"""Link columns (T17, T18, H13): relative to absolute, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventmill.functions.text import blank_to_null, let

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
# scheme, //host, path, query, fragment of an address
ALL_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"
SPLIT = "\uffff"  # no character, so in no address
PARTS = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, "(?s)" + PARTS, group)


def url_parts(url: Column) -> Column:
    """What resolving against `url` needs; compute it once per source."""
    path = _part(url, 2)
    return F.struct(
        url.alias("url"),
        F.lower(F.regexp_extract(url, SCHEME, 1)).alias("scheme"),
        _part(url, 1).alias("host"),
        path.alias("path"),
        # What a relative path is put behind: all up to the last slash.
        F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "^(.*/)?", 1)).alias("folder"),
        _part(url, 3).alias("query"),
    )


def _tidy_path(path: Column, relative: Column, hosted: Column) -> Column:
    """Resolve dot segments; a relative path also loses doubled slashes. Behind a host
    a path begins with a slash."""

    def walked(segments: Column) -> Column:
        last = F.size(segments) - 1
        inner = F.filter(segments, lambda s, i: ~relative | (i == 0) | (i == last) | (s != ""))
        return F.aggregate(
            inner,
            F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(s == ".", done)
            .otherwise(F.concat(done, F.array(s))),
        )

    def rooted(rebuilt: Column) -> Column:
        slash = (rebuilt == "") | (hosted & ~rebuilt.startswith("/"))
        return F.concat(F.when(slash, F.lit("/")).otherwise(F.lit("")), rebuilt)

    # Each step is worked out once, for however many segments.
    kept = let(F.split(path, "/", -1), walked)
    end = F.when(path.rlike(r"(^|/)\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    tidied = let(F.array_join(F.concat(kept, end), "/"), rooted)
    return F.when(path.rlike(r"//|/\.|^\."), tidied).otherwise(path)


def link_parts(href: Column) -> Column:
    """[scheme, //host, path, ?query, #fragment] of a link as written."""
    link = F.regexp_replace(href, F.lit(r"^[\x00-\x20]+|[\t\r\n]"), F.lit(""))
    groups = SPLIT.join(f"${i}" for i in range(1, 6))
    return F.split(F.regexp_replace(link, F.lit(ALL_PARTS), F.lit(groups)), SPLIT, -1)


def resolve_parts(href: Column, parts: Column, base: Column) -> Column:
    """Absolute form of `href`, whose ``link_parts`` are `parts`, on the page
    whose ``url_parts`` are `base`."""
    scheme, host, path, query, fragment = (F.get(parts, F.lit(i)) for i in range(5))
    scheme = F.lower(scheme)
    # An empty query or fragment is none.
    query, fragment = F.nullif(query, F.lit("?")), F.nullif(fragment, F.lit("#"))
    query, fragment = blank_to_null(query), F.coalesce(fragment, F.lit(""))
    own_query = F.coalesce(query, F.lit(""))
    # A base without a scheme, or without a host, gives none.
    lead = F.concat(base["scheme"], F.when(base["scheme"] == "", F.lit("")).otherwise(F.lit(":")))
    home, hosted = F.concat(lead, base["host"]), F.char_length(base["host"]) > 2
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(base["folder"], path))
    return (
        F.when(((scheme != "") & (scheme != base["scheme"])) | (base["url"] == ""), href)
        .when(
            F.char_length(host) > 2,
            F.concat(lead, host, path, own_query, fragment),
        )
        .when(F.array_join(parts, "") == "", base["url"])
        .when(path == "", F.concat(home, base["path"], F.coalesce(query, base["query"]), fragment))
        .otherwise(
            F.concat(home, _tidy_path(rooted, ~path.startswith("/"), hosted), own_query, fragment)
        )
    )


def resolve_url(href: Column, base: Column) -> Column:
    """``resolve_parts`` where there is no column to keep the parts in."""
    resolved = F.transform(
        F.array(link_parts(href)), lambda parts: resolve_parts(href, parts, base)
    )
    return F.get(resolved, F.lit(0))


def url_path(url: Column) -> Column:
    return _part(url, 2)


def path_root(url: Column) -> Column:
    """Path of an address without trailing slashes."""
    return F.rtrim(_part(url, 2), F.lit("/"))


def url_host(url: Column) -> Column:
    return F.substring(_part(url, 1), 3, 2**31 - 1)


def srcset_first(c: Column) -> Column:
    first = F.trim(F.split_part(c, F.lit(","), F.lit(1)))
    return F.split_part(first, F.lit(" "), F.lit(1))
