"""Column functions against hand-written answers and the standard library."""

import random
import re
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from eventmill.functions import dates, places, text, urls


@pytest.fixture
def ask(spark):
    """Answers of a column of `c` for a list of texts."""

    def run(texts, *functions):
        columns = []
        for function in functions:
            made = function(F.col("c"))
            columns += made if isinstance(made, tuple) else [made]
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string")
        # Kept behind an aggregate, or the optimizer would fold the constants.
        rows = rows.groupBy("i").agg(F.max("c").alias("c"))
        found = rows.select("i", *[c.alias(f"x{n}") for n, c in enumerate(columns)]).orderBy("i")
        return [row[1] if len(columns) == 1 else tuple(row[1:]) for row in found.collect()]

    return run


def test_clean_and_shorten(ask):
    got = ask(["  a\t\n b  c\x1c ", "abcdefghij", "abcd fghij"], lambda c: text.shorten(c, 8))
    assert got == ["a b c", "abcde...", "abcd..."]
    assert ask(["Go  Google Calendar\nICS View Event → on"], lambda c: text.drop_calendar_noise(c)) == ["Go on"]
    assert ask(["Go view event → on"], lambda c: text.drop_calendar_noise(c, trim_arrow=False)) == ["Go → on"]


def test_long_dates(ask):
    samples = {
        "Sunday, July 12, 2026": "Sunday, July 12, 2026",
        "on Jul 5": " Jul 5",
        "July 12 2026": "July 12",
        "Thursday Dec 1": "Thursday Dec 1",
        "x, Feb 29": ", Feb 29",
        "Sept 12": "",
        "Jul. 5": "",
        "July 12th": "",
        "July 2026": "",
        "JULY 12": "",
        "May 123": "",
        "Wednesday, Mar  3,2027.": "Wednesday, Mar  3,2027",
    }
    assert ask(list(samples), lambda c: dates.long_date_first(c)) == list(samples.values())
    assert ask(["JULY 12"], lambda c: dates.long_date_first(c, any_case=True)) == ["JULY 12"]
    line = "May 1, 2026 to May 2, 2026 or Jun 3"
    several = ask([line, "none"], lambda c: dates.long_date_second(c), lambda c: dates.long_date_last(c))
    assert several == [(" May 2, 2026", " Jun 3"), ("", "")]
    assert ask([line], lambda c: dates.drop_first_long_date(c)) == ["to May 2, 2026 or Jun 3"]
    assert ask(["A 5/6/2026 B 2026-05-06 May 4", "May 4"], lambda c: dates.drop_all_dates(c)) == ["A B", "May 4"]


def test_dates_are_found_where_plain_regular_expressions_find_them(ask):
    """The library's fixed grammar in Python's dialect, without any shortcut."""
    plain = dates.LONG_DATE.replace(dates.AT_WEEKDAY, "").replace(dates.AT_MONTH, "")
    assert "(?=" not in plain
    clock = places.CLOCK
    rng = random.Random(3)
    bits = """Sun|Sunday|day|,| |  |July|Jul|May|Sept|Decem|ber|December|12|3|2026|, 2026|x|é|-|to|
AM|pm|9|:30|10:00 AM|Tues|sday|Wednesday|.|\u00a0|١|Mar\u00e7|March 1""".replace("\n", "").split("|")
    texts = ["".join(rng.choices(bits, k=rng.randint(2, 14))) for _ in range(12000)]

    def first(pattern, text, group=0):
        found = re.search(pattern, text)
        return found[group] if found else ""

    spans = rf"\b{clock}\s*(?:-|to|–|—|\s+)\s*{clock}\b"
    want = [
        (first(plain, t), (re.findall(plain, t) or [""])[-1], first(spans, t)) for t in texts
    ]
    got = ask(
        texts,
        lambda c: dates.long_date_first(c),
        lambda c: dates.long_date_last(c),
        lambda c: places.time_words(c),
    )
    assert got == want
    assert sum(bool(w[0]) for w in want) > 300


def test_post_dates(ask):
    texts = ["May 4 or 5/6/26 or 2026-07-08", "May 4 or 5/6/26", "5/6/2026", "at 12026-07-08"]
    assert ask(texts, lambda c: dates.post_date(c)) == ["2026-07-08", "5/6/26", "", ""]
    assert ask(["5/6/2026"], lambda c: dates.post_date(c, long_years=True)) == ["5/6/2026"]
    assert ask(["june 2026 x", "June 26"], lambda c: dates.month_year(c)) == ["june 1, 2026", ""]


def test_normalized_dates(ask):
    samples = {
        "": "", "July 12, 2026": "2026-07-12", ", Jul 5": "2026-07-05", "June 30": "2027-06-30",
        "Jul 1": "2026-07-01", "Feb 29": "2028-02-29", "Feb 30": "", "February 29, 2027": "",
        "7/2/26": "2026-07-02", "13/02/26": "", "2026-02-30": "", "2026-12-31": "2026-12-31",
        "7/2/2031": "2031-07-02", "june 1, 2026": "2026-06-01", "4/31/26": "",
    }
    assert ask(list(samples), lambda c: dates.normalize_date(c, "2026-07-01")) == list(samples.values())
    assert ask(["Feb 29"], lambda c: dates.normalize_date(c, "2028-02-29")) == ["2028-02-29"]
    assert ask(["Feb 29"], lambda c: dates.normalize_date(c, "2028-03-01")) == ["2032-02-29"]
    assert ask(["Feb 29"], lambda c: dates.normalize_date(c, "2097-01-01")) == ["2104-02-29"]


def test_times(ask):
    samples = {
        "at 10:00 AM - 5 pm": ("10:00 AM", "5 PM"), "10am to 2PM": ("10AM", "2PM"),
        "9 AM 10 AM": ("9 AM", "10 AM"), "9 AM – 10 AM": ("9 AM", "10 AM"), "9 AM": ("", ""),
        "9 - 10 AM": ("", ""), "9 Am - 10 AM": ("", ""),
    }
    assert ask(list(samples), lambda c: places.time_range(c)) == list(samples.values())
    assert ask(["9 AM – 10 AM"], lambda c: places.time_range(c, wide_dashes=False)) == [("", "")]


def test_places(ask):
    samples = {
        "Location: 1 Main Street, Keene, NH 03431 now": "1 Main Street, Keene, NH 03431",
        "Location: 1 Main St, Keene, NH": "1 Main St",  # any two-letter word ends it
        "location: Meet at Town Hall": "Meet at",
        "Meeting Place: HQ": "HQ",
        "Location: The Barn. Bring boots": "The Barn",
        "Meeting Place: The Barn. Location: The Mill": "The Mill",
        "Nowhere": "",
    }
    assert ask(list(samples), lambda c: places.location(c)) == list(samples.values())
    assert ask(["Meeting Place: A to B; c"], lambda c: places.location(c, to_state=False)) == ["A to B"]


LINKS = """|/a|a|../x|./x|../../../x|//cdn.e.org/k.png|https://o.org/p//q?a#b|http://o.org|mailto:a@b.c|tel:1
?q=1|#f|#|?|/a//b|a//b|a/../b|..|.|a/./b/|x?y#z|HTTPS://Up.org/x|javascript:void(0)|/a/..|  /sp|a b|https:foo
x?|/p#|a;b|../..//c|//|///x|/../x|a/b/../../../c|.hidden|a/.b/..c""".replace("\n", "|").split("|")
BASES = ["https://e.org/events", "https://e.org/Events/", "https://e.org", "http://e.org/a/b?q=2#f"]
BASES += ["//h.org/a/b", "//h.org", "/x/y", "a/b?q", "h.org/x/", "?q", "", "x"]  # without scheme, host or both


@pytest.mark.parametrize("base", BASES)
def test_links_resolve_as_in_the_standard_library(ask, base):
    got = ask(LINKS, lambda c: urls.resolve_url(c, urls.url_parts(F.lit(base))))
    assert got == [urljoin(base, link) for link in LINKS]


def test_url_pieces(ask):
    links = ["https://e.org/a/b//?q#f", "https://e.org", "mailto:x", "/p/"]
    assert ask(links, lambda c: urls.path_root(c)) == [urlparse(u).path.rstrip("/") for u in links]
    sets = [" /a.png 1x, /b.png 2x", "/c.png", ""]
    assert ask(sets, lambda c: urls.srcset_first(c)) == ["/a.png", "/c.png", ""]


def test_date_and_place_are_looked_for_once_each(spark):
    """Inside lambda functions Spark works out each mention of an expression anew."""
    texts = spark.createDataFrame([(["July 4, 2026"],)], "texts array<string>")

    def searches(column):
        plan = texts.select(F.transform("texts", column).alias("c"))._jdf.queryExecution().optimizedPlan()
        return plan.toString().lower().count("regexp_extract(")

    assert 0 < searches(lambda c: dates.normalize_date(c, "2026-07-01")) <= 3
    assert 0 < searches(lambda c: places.location(c)) <= 5


def test_a_link_is_tidied_once(spark):
    """A path is split and walked in one place of the plan, and not again for each segment."""
    links = spark.createDataFrame([("../../news/7",)], "c string")
    base = urls.url_parts(F.lit("https://e.org/category/news/"))
    plan = links.select(urls.resolve_url(F.col("c"), base).alias("r"))._jdf.queryExecution().analyzed().toString().lower()
    # One more is the split of the link into its parts.
    assert (plan.count("split("), plan.count("aggregate(")) == (2, 1)


def test_a_first_date_takes_the_rest_along_in_one_search(ask):
    lines = ["a  May 4, 2026 b\n c June 5 d", "no date", "May 4", " x, Sunday,  May 4\n", ""]
    assert ask(lines, lambda c: dates.drop_first_long_date(c)) == ["a b c June 5 d", "no date", "", "x,", ""]
    plan = []
    ask(["a"], lambda c: plan.append(str(dates.drop_first_long_date(c))) or c)
    assert ".*?" not in plan[0]


def test_odd_dates_read_by_their_words(spark):
    cases = {
        "July 4": "2026-07-04",
        "Wednesday, March 3, 1999 ": "1999-03-03",
        "x Jan 1, 0000": "0000-01-01",
        "February 30, 2026": "",
        "Feb 29": "2028-02-29",
        "Foo 12": "",
        "4": "",
        "": "",
        None: "",
    }
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    found = rows.select("i", dates.normalize_date(F.col("c"), "2026-07-01")).collect()
    assert [r[1] for r in sorted(found)] == list(cases.values())
