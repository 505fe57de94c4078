"""Time and place columns (T14, T15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventmill.functions.text import clean_text, let, or_else

# How a pair of clock times and a place are written.
CLOCK = r"(\d{1,2}(?::\d{2})?\s*(?:AM|PM|am|pm))"
TIME_RANGE = rf"(?U)(?=\d)\b{CLOCK}\s*(?:-|to|\s+)\s*{CLOCK}\b"
TIME_RANGE_WIDE = rf"(?U)(?=\d)\b{CLOCK}\s*(?:-|to|–|—|\s+)\s*{CLOCK}\b"
# L and M have no other cases: outside of what is read in any case they are found sooner.
LABEL = r"[LlMm](?iU:(?:(?<=L)ocation|(?<=M)eeting Place):\s*"
PLACE_TO_STATE = LABEL + r"(.*?\b[A-Z]{2}(?:\s+\d{5})?)\b)"
PLACE_TO_PERIOD = [r"[Ll](?iU:ocation:\s*([^.]+))", r"[Mm](?iU:eeting Place:\s*([^.]+))"]
PLACE_TO_PUNCTUATION = r"(?U)(?=[LlMm])\b" + LABEL + r"([^.;]+))"


def time_words(c: Column, wide_dashes: bool = True) -> Column:
    """The first two clock times that stand together, with what is between."""
    return F.regexp_extract(c, TIME_RANGE_WIDE if wide_dashes else TIME_RANGE, 0)


def time_range(c: Column, wide_dashes: bool = True) -> tuple[Column, Column]:
    """Upper-cased start and end; both blank unless two times stand together."""
    pattern = TIME_RANGE_WIDE if wide_dashes else TIME_RANGE
    start, end = (F.upper(clean_text(F.regexp_extract(c, pattern, i))) for i in (1, 2))
    return start, end


def location(c: Column, to_state: bool = True) -> Column:
    """Place named after its label, up to the first two-letter word if any."""
    if not to_state:
        return clean_text(F.regexp_extract(c, PLACE_TO_PUNCTUATION, 1))

    def up_to_period(patterns: list[str]) -> Column:
        if not patterns:
            return F.lit("")
        # Group 0 tells a match with a blank place from no match.
        return let(
            F.regexp_extract(c, patterns[0], 0),
            lambda m: F.when(m != "", F.regexp_extract(m, patterns[0], 1)).otherwise(up_to_period(patterns[1:])),
        )

    return clean_text(or_else(F.regexp_extract(c, PLACE_TO_STATE, 1), up_to_period(PLACE_TO_PERIOD)))
