"""Date columns (T3-T13): find the date words in a text, then make ISO dates.

All dates are ISO strings, blank when unknown. Everything is a built-in Spark
expression, so a date job stays inside the JVM.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventmill.functions.text import blank_to_null, clean_text, let, or_else

# The accepted ways to write a date.
MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
MONTH = "(?:" + "|".join(f"{name}|{name[:3]}" for name in MONTHS) + ")"
WEEKDAY = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)?(?:day|sday|nesday|rsday|urday)?"
# The lookaheads only give up early where neither a weekday nor a month can start: before
# the word boundary, which costs more to look for than a character.
AT_WEEKDAY = r"(?=[JFMASONDTW,]|[dsnru][adesr]|[^!-~](?<=\s)\s*[JFMASOND])"
AT_MONTH = "(?=[JFMASOND])"
LONG_DATE = (
    rf"{AT_WEEKDAY}\b{WEEKDAY},?\s*{AT_MONTH}{MONTH}\s+\d{{1,2}}(?:,\s*\d{{4}})?\b"
)
ISO_DATE = r"(?=\d)\b\d{4}-\d{2}-\d{2}\b"
NUMERIC_DATE = r"(?=\d)\b\d{1,2}/\d{1,2}/\d{2,4}\b"
SHORT_NUMERIC_DATE = r"(?=\d)\b\d{1,2}/\d{1,2}/\d{2}\b"
MONTH_YEAR = rf"\b({MONTH})\s+(\d{{4}})\b"
WORDED = r"(?iU)([a-z]{3})[a-z]*\s+(\d{1,2})(?:,\s*(\d{4}))?\s*$"
MONTH_STARTS = "".join(name[:3].lower() for name in MONTHS)


def _long(any_case: bool) -> str:
    return ("(?iU)" if any_case else "(?U)") + LONG_DATE


def _extract(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(c, pattern, group)


def long_date_first(c: Column, any_case: bool = False) -> Column:
    return _extract(c, _long(any_case))


def long_dates(c: Column, any_case: bool = False) -> Column:
    return F.regexp_extract_all(c, F.lit(_long(any_case)), F.lit(0))


def long_date_second(c: Column, any_case: bool = False) -> Column:
    return F.coalesce(F.get(long_dates(c, any_case), F.lit(1)), F.lit(""))


def long_date_last(c: Column, any_case: bool = False) -> Column:
    return F.coalesce(F.try_element_at(long_dates(c, any_case), F.lit(-1)), F.lit(""))


def drop_first_long_date(c: Column, any_case: bool = False) -> Column:
    # The date takes all behind it along, so there is no second one to be found.
    pattern = f"(?s){_long(any_case)}(.*)"
    return clean_text(F.regexp_replace(c, F.lit(pattern), F.lit("$1")))


def drop_all_dates(c: Column) -> Column:
    """The text without any date; the text itself if nothing would be left."""
    rest = c
    for pattern in (LONG_DATE, NUMERIC_DATE, ISO_DATE):
        rest = F.regexp_replace(rest, F.lit("(?U)" + pattern), F.lit(""))
    return or_else(clean_text(rest), c)


def iso_date(c: Column) -> Column:
    return _extract(c, "(?U)" + ISO_DATE)


def numeric_date(c: Column, long_years: bool = False) -> Column:
    return _extract(c, "(?U)" + (NUMERIC_DATE if long_years else SHORT_NUMERIC_DATE))


def post_date(c: Column, any_case: bool = False, long_years: bool = False) -> Column:
    """ISO before numeric before long form, wherever they stand in the text."""
    return or_else(
        iso_date(c), or_else(numeric_date(c, long_years), long_date_first(c, any_case))
    )


def month_year(c: Column) -> Column:
    pattern = "(?iU)" + MONTH_YEAR
    month = blank_to_null(_extract(c, pattern, 1))
    return F.coalesce(F.concat(month, F.lit(" 1, "), _extract(c, pattern, 2)), F.lit(""))


def normalize_date(c: Column, base_date: str) -> Column:
    """ISO date of a date text, blank if there is no such day.

    Numeric dates are month first, two-digit years lie in 20yy, and a date
    without a year is the first such day on or after `base_date`.
    """
    base = date.fromisoformat(base_date)

    def of_numbers(c: Column) -> Column:
        digits = F.regexp_replace(
            F.regexp_replace(c, F.lit(r"^\s*(\d{1,2}/\d{1,2})/(\d{2})\s*$"), F.lit("$1/20$2")),
            F.lit(r"^\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*$"),
            F.lit("$3-$1-$2"),
        )
        return F.try_to_date(F.trim(digits), "yyyy-M-d")

    # Each step is worked out once: the words of the date, the month in them, the rest.
    def of_words(words: Column) -> Column:
        place = F.position(F.lower(F.substring(words, 1, 3)), F.lit(MONTH_STARTS))
        return F.when(words != "", let(place, lambda p: F.when(p > 0, in_month(words, p))))

    def in_month(words: Column, place: Column) -> Column:
        month = F.lpad(((place + 2) / 3).cast("int").cast("string"), 2, "0")
        day = F.lpad(_extract(words, r"(?U)\d{1,2}"), 2, "0")
        year = F.when(F.contains(words, F.lit(",")), _extract(words, r"(?U),\s*(\d{4})", 1))
        return let(
            F.concat(month, F.lit("-"), day),
            lambda md: F.concat(F.coalesce(year, _year_ahead(md, base)), F.lit("-"), md).try_cast("date"),
        )

    day = F.when(c.rlike(r"^\s*\d"), of_numbers(c)).otherwise(let(_extract(c, WORDED), of_words))
    return F.coalesce(F.when(c != "", day).cast("string"), F.lit(""))


def _year_ahead(month_day: Column, base: date) -> Column:
    """Year of the first such `MM-dd` on or after `base`."""
    leap = base.year + (not _is_leap(base.year) or f"{base:%m-%d}" > "02-29")
    while not _is_leap(leap):
        leap += 1
    return (
        F.when(month_day == "02-29", F.lit(str(leap)))
        .when(month_day < f"{base:%m-%d}", F.lit(str(base.year + 1)))
        .otherwise(F.lit(str(base.year)))
    )


def _is_leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
