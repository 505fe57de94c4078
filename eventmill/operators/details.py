"""Detail pages (H17, R4, R5): fill records from the page they link to."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.functions import dates, places
from eventmill.functions.text import blank_to_null
from eventmill.functions.urls import resolve_url, url_parts
from eventmill.operators import shape
from eventmill.operators.tree import with_tree
from eventmill.operators.extractors import detail_layouts
from eventmill.schema import Options
from eventmill.session import stored


#: Addresses of detail pages that are sent to every task, at most; some 100 bytes each.
SENT_ADDRESSES = 100_000
#: Beyond that a filter of them is sent: its bits (a power of two) at least and at most, 16 MB.
LEAST_BITS, MOST_BITS = 16, 27
#: Bits that an address sets.
PROBES = 4


def address_filter(wanted: DataFrame, n: int) -> tuple[int, bytes]:
    """(bits, words) of a Bloom filter of the column `url` of some n addresses.

    The bits are united by partial aggregation, word by word: what a task sends, and what
    comes together, is bounded by the filter's size, not by the addresses.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, (12 * n).bit_length()))
    places = F.explode(F.array(*_places(F.col("url"), bits)))
    words = wanted.select(places.alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    found = words.agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(1 << max(0, bits - 6), np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits, table.tobytes()


def _places(url: Column, bits: int) -> list[Column]:
    """The bits of an address."""
    return [F.shiftrightunsigned(F.xxhash64(url, F.lit(k)), 64 - bits) for k in range(PROBES)]


def may_be_wanted(pages: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """`pages` without most of those whose `url` is not among the wanted; none of these is lost.

    Only hashes of the addresses go to Python; no page moves between tasks.
    """
    bits, words = address_filter(wanted, n)
    sent = pages.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def known(places: pa.Array) -> pa.Array:
        table = np.frombuffer(sent.value, np.int64)
        at = places.flatten().to_numpy(zero_copy_only=False).reshape(-1, PROBES)
        return pa.array(((table[at >> 6] >> (at & 63)) & 1).all(axis=1))

    return pages.filter(F.col("url").isNotNull()).filter(known(F.array(*_places(F.col("url"), bits))))


def _read(pages: DataFrame) -> DataFrame:
    """(url, page_id, description, image) of detail pages, each read where it lies."""
    return with_tree(pages.select("url", "page_id", "html")).select(
        "url",
        "page_id",
        shape.article_description().alias("description"),
        shape.article_image().alias("image"),
    )


def _told(read: DataFrame, opts: Options) -> DataFrame:
    known = read.filter((F.col("description") != "") | (F.col("image") != ""))
    text = F.col("description")
    start = dates.post_date(text, opts.any_case_dates, opts.long_numeric_years)
    second = dates.long_date_second(text, opts.any_case_dates)
    start_time, end_time = places.time_range(text, opts.wide_dashes)
    image = F.when(F.col("image") == "", F.lit("")).otherwise(
        resolve_url(F.col("image"), url_parts(F.col("url")))
    )
    return known.withColumns({"start_text": start, "end_text": second}).select(
        "url",
        dates.normalize_date(F.col("start_text"), opts.base_date).alias("start_date"),
        dates.normalize_date(F.col("end_text"), opts.base_date).alias("end_date"),
        start_time.alias("start_time"),
        end_time.alias("end_time"),
        places.location(text, opts.location_to_state).alias("location"),
        "description",
        image.alias("image_url"),
    )


def article_details(pages: DataFrame, opts: Options = Options()) -> DataFrame:
    """url -> description, image and what the description says of the event."""
    return _told(_read(pages.withColumn("page_id", F.lit(0))), opts)


def detail_candidates(records: DataFrame) -> DataFrame:
    """Records of layouts that only announce what a page of their own tells."""
    return records.filter(F.col("parser").isin(detail_layouts()))


def enrich(records: DataFrame, detail_pages: DataFrame, opts: Options = Options()) -> DataFrame:
    """Each non-blank value of a record's detail page replaces the listing's.

    Page texts never move: where the wanted addresses are few enough to be sent to
    every task, pages of others are left out at the scan; else a filter of a bounded
    size is sent, which leaves most of them out before they are read as trees. Of copies of a page the first one counts; it is chosen, like
    the join, on the short values that were read. Records that ask for no page get a join
    key of their own that no address equals, so they spread over the tasks; an
    address that many records share is split by AQE.
    """
    # Looked at twice, for its addresses and for its rows: found out only once.
    records = stored(records)
    wanted = stored(detail_candidates(records).select("url").distinct())
    n = wanted.count()
    if n <= SENT_ADDRESSES:
        detail_pages = detail_pages.join(F.broadcast(wanted), "url", "left_semi")
    else:
        detail_pages = may_be_wanted(detail_pages, wanted, n)
    values = F.struct("description", "image")
    firsts = _read(detail_pages).groupBy("url").agg(F.min_by(values, "page_id").alias("first"))
    found = _told(firsts.select("url", "first.*"), opts)
    values = [c for c in found.columns if c != "url"]
    found = found.select(F.col("url").alias("_at"), *[F.col(c).alias(f"_{c}") for c in values])
    asks = F.col("parser").isin(detail_layouts())
    no_page = F.concat_ws(" ", F.lit(" none"), "page_id", "node_id")
    keyed = records.withColumn("_key", F.when(asks, F.col("url")).otherwise(no_page))
    joined = keyed.join(found, F.col("_key") == F.col("_at"), "left")
    filled = {c: F.coalesce(blank_to_null(F.col(f"_{c}")), F.col(c)) for c in values}
    return joined.withColumns(filled).select(*records.columns)
