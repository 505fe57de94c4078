"""What several operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventmill.session import stored

# Words are runs of anything but ASCII white space.
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Buckets that a key's rows are dealt to when running sums are formed.
BUCKETS = 256


def word_list(text: Column) -> Column:
    """The words of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, BLANKS)).otherwise(
        F.array().cast("array<string>")
    )


def word_count(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.size(word_list(text)).cast("long")


def let(value: Column, body) -> Column:
    """`body(value)` with `value` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def in_hash_order(
    df: DataFrame, keys: list[str], order: Column, ties: list[Column], measure: Column, start: str
) -> DataFrame:
    """Add `start`: the sum of `measure` over the key's rows that come earlier.

    A key's rows are put in the order of `order`, a 64-bit hash, and then `ties`.
    They are dealt to BUCKETS ranges of the hash, summed there, and each bucket's
    own running sum starts where the buckets before it end; so a key that holds
    most of the table is as parallel as any other. Keys may be null.
    """
    bucket = F.shiftrightunsigned(F.col("_order").bitwiseXOR(F.lit(-(1 << 63))), 56)
    rows = df.withColumn("_order", order).withColumn("_measure", measure.cast("long"))
    rows = rows.withColumn("_bucket", bucket.cast("int"))
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum("_measure").alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_k_bucket"),
        F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"),
    )
    within = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("_order", *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("_in", F.coalesce(F.sum("_measure").over(within), F.lit(0)))
    same = F.col("_bucket") == F.col("_k_bucket")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        rows.join(bases, same)
        .withColumn(start, F.col("_base") + F.col("_in"))
        .drop("_order", "_measure", "_bucket", "_in", "_base", "_k_bucket", *[f"_k_{k}" for k in keys])
    )


def in_range_order(df: DataFrame, keys: list[str], order: list[Column], place: str) -> DataFrame:
    """Add `place`, the row's 0-based place among its key's rows in the given order.

    The table is sorted in ranges of (keys, order), so a large key lies in many of
    them; a row's place is that within its range plus the rows of its key in earlier
    ranges. Only one count per range and key goes through a window. Keys may be null.
    """
    by = [*[F.col(k) for k in keys], *order]
    # Range bounds come from a sample: the outcome is stored, so that all steps see the same.
    seated = df.repartitionByRange(*by).sortWithinPartitions(*by)
    seated = stored(seated.withColumn("_seat", F.monotonically_increasing_id()))
    seated = seated.withColumn("_part", F.shiftrightunsigned("_seat", 33))
    counts = seated.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_seat").alias("_first"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_k_part"),
        (F.coalesce(F.sum("_n").over(ahead), F.lit(0)) - F.col("_first")).alias("_base"),
    )
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        seated.join(stored(bases), same)
        .withColumn(place, F.col("_base") + F.col("_seat"))
        .drop("_seat", "_part", "_base", "_k_part", *[f"_k_{k}" for k in keys])
    )
