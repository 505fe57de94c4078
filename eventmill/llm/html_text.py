"""Main text of pages by differencing against the pages of nearest URL.

Pages of a host are put in the order of their paths, so that a page's neighbours are
those with the nearest URLs. A page's text lines are aligned with each neighbour's by
longest common subsequence, and lines that both have are deleted: what a site repeats
is not an article. The article itself is protected: lines within `article` or `main`
stay, since real texts repeat passages too. Of the lines outside that no neighbour
shares, an exact check drops those that the markup names as menus, headers, footers,
sidebars, notices, adverts, forms or reader comments.

Only line hashes travel to the neighbours; texts are moved once.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventmill.llm.common import in_range_order
from eventmill.llm.url_filter import host_and_path
from eventmill.session import stored

MAIN, NOISE, OPEN = 0, 1, 2
#: Of two neighbours, one that shares this share of a page's unmarked lines, where the other shares
#: less, is a near copy of the page.
COPY_SHARE = 0.8

#: Elements that hold no article text, wherever they are.
NOISE_TAGS = frozenset(
    "nav footer aside form menu dialog button select head noscript template iframe object svg canvas audio video map".split()
)
#: Words that name such elements in a class or id, unless its token also says that it is a state or the content.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond "
    "share sharing social related recommended newsletter subscribe subscription signup popup modal overlay footer adsbygoogle "
    "masthead topbar toolbar widget widgets pagination pager login search form".split()
)
STATE_WORDS = frozenset(
    "has have no non not without with is are open opened closed enabled disabled active allow show hide content contents layout "
    "page body text title article story".split()
)
PLAIN_WORDS = frozenset(
    "area bar block bottom box buttons container foot group holder inner item items left links list outer panel right row "
    "section site slot top unit wrap wrapper".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that browsers close by themselves; they end with their block.
LOOSE_TAGS = frozenset("p li dt dd option td th tr h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|noembed|noframes)\b(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?P<close>>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-z][\w-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S | re.I)
_WORD = re.compile(r"[A-Za-z]+")


def _is_noise(tag: str, rest: str, in_main: bool) -> bool:
    return tag in NOISE_TAGS or (tag == "header" and not in_main) or bool(rest and _marked(tag, rest, in_main))


def _marked(tag: str, rest: str, in_main: bool) -> str | None:
    """The kind of attribute that marks an element as noise: `class`, which is a hint, or `role`."""
    if tag in ("body", "html"):
        return None
    hint = None
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            if tag not in ("article", "main") and any(_names_noise(token, in_main) for token in value.lower().split()):
                hint = "class"
        elif name == "role":
            if value.lower() in NOISE_ROLES:
                return "role"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "role"
    return hint


def _names_noise(token: str, in_main: bool) -> bool:
    words = set(_WORD.findall(token))
    if "header" in words and not in_main:
        words -= {"header", "page"}
        return words <= NOISE_WORDS | PLAIN_WORDS
    return bool(words & NOISE_WORDS) and not words & STATE_WORDS


def page_blocks(html: str | None) -> tuple[list[str], list[int]]:
    """Text blocks of a page in order, and whether each is main, noise or open.

    A `main` within an element that only its class or id marks as noise is main all
    the same; so is an `article`, on a page that has no main text otherwise.
    """
    blocks, zones, hinted = _page_blocks(html, False)
    if hinted and MAIN not in zones:
        blocks, zones, _ = _page_blocks(html, True)
    return blocks, zones


def _page_blocks(html: str | None, reopen: bool) -> tuple[list[str], list[int], bool]:
    """Blocks, zones, and whether an article lies in an element outside main that only a class marks.

    End tags close the nearest open element of their name and are ignored without
    one, as browsers do for the most part; what is open at the end is closed.
    """
    blocks: list[str] = []
    zones: list[int] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool]] = []  # open containers, with the zone and hint around them
    zone, loose_zone = OPEN, None
    hint = hinted = False  # whether a mere class began the noise
    source = html or ""

    def close() -> None:
        nonlocal loose_zone
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append(text)
            zones.append(zone if loose_zone is None else loose_zone)
        loose_zone = None

    def say(piece: str) -> None:
        parts.append(entities.unescape(piece) if "&" in piece else piece)

    at = 0
    for token in _TOKEN.finditer(source):
        if token.start() > at:
            say(source[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None or not token["close"]:  # a tag that nothing closes takes all that follows
            continue
        tag, rest = tag.lower(), token["rest"]
        if tag == "br":
            parts.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            close()
        if tag in VOID_TAGS:
            continue
        if token["end"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if not block and stack[depth][1] != zone:
                        close()
                    _, zone, hint = stack[depth]
                    del stack[depth:]
                    break
            continue
        if tag in LOOSE_TAGS:
            if zone != NOISE and rest and _is_noise(tag, rest, zone == MAIN):
                loose_zone = NOISE
            continue
        noisy = zone != NOISE and _is_noise(tag, rest, zone == MAIN)
        if block or noisy or tag in NOISE_TAGS:
            if rest.rstrip().endswith("/") and not block:
                continue
            if not block:
                close()
            stack.append((tag, zone, hint))
            if noisy:
                hint = zone == OPEN and tag not in NOISE_TAGS and tag != "header" and _marked(tag, rest, False) == "class"
                zone = NOISE
            elif zone == OPEN and (tag in ("article", "main")):
                zone = MAIN
            elif hint and tag in NOISE_TAGS | {"header"} or (hint and _marked(tag, rest, False) == "role"):
                hint = False  # noise by more than a class
            elif hint and tag in ("article", "main"):
                hinted = True
                if reopen or tag == "main":
                    zone, hint = MAIN, False
    tail = source[at:]
    if tail and not tail.startswith("<"):
        say(tail.split("<", 1)[0] if re.search(r"<[a-z/!]", tail, re.I) else tail)
    close()
    return blocks, zones, hinted


def common_lines(a: list, b: list) -> list[int]:
    """Positions in `a` of a longest common subsequence with `b`.

    Hirschberg's halving over bit-parallel rows: memory is linear, and time is the
    product of the lengths over the width of a machine word.
    """
    out: list[int] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        lo, hi, left, right = stack.pop()
        while lo < hi and left < right and a[lo] == b[left]:
            out.append(lo)
            lo, left = lo + 1, left + 1
        while lo < hi and left < right and a[hi - 1] == b[right - 1]:
            hi, right = hi - 1, right - 1
            out.append(hi)
        if lo >= hi or left >= right:
            continue
        if hi - lo == 1:
            if a[lo] in b[left:right]:
                out.append(lo)
            continue
        mid = (lo + hi) // 2
        front = _lengths(a[lo:mid], b[left:right])
        back = _lengths(a[mid:hi][::-1], b[left:right][::-1])[::-1]
        cut = left + int(np.argmax(front + back))
        stack += [(lo, mid, left, cut), (mid, hi, cut, right)]
    return sorted(out)


def _lengths(a: list, b: list) -> np.ndarray:
    """Lengths of the longest common subsequences of `a` with every prefix of `b`."""
    places: dict = {}
    for i, value in enumerate(b):
        places[value] = places.get(value, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for value in a:
        hit = row & places.get(value, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8)
    zeros = 1 - np.unpackbits(bits, bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def _lines_task(batches: Iterator[pa.RecordBatch]):
    """Zones of a page's blocks, and the hashes of those outside the main zone."""
    for batch in batches:
        zones, lines = [], []
        for html in batch.column(3):
            texts, where = page_blocks(html.as_py())
            zones.append(where)
            lines.append([xxhash.xxh3_64_intdigest(t) - (1 << 63) for t, z in zip(texts, where, strict=True) if z != MAIN])
        yield pa.record_batch(
            [*batch.columns[:3], pa.array(zones, pa.list_(pa.int8())), pa.array(lines, pa.list_(pa.int64()))],
            names=["k1", "k2", "url", "zones", "lines"],
        )


def _blocks_task(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        blocks = [page_blocks(html.as_py())[0] for html in batch.column(4)]
        yield pa.record_batch(
            [*batch.columns[:4], pa.array(blocks, pa.list_(pa.string()))], names=["k1", "k2", "url", "page_id", "blocks"]
        )


def kept_blocks(zones: list[int], lines: list[int], neighbours: list[list[int] | None]) -> list[bool]:
    """Which blocks stay; `lines` are those outside the main zone, in order."""
    outside = [z for z in zones if z != MAIN]
    unmarked = np.array([z == OPEN for z in outside], bool)
    found = []
    for other in neighbours:
        if other and lines:
            now = np.zeros(len(lines), bool)
            now[common_lines(lines, other)] = True
            found.append(now)
    if MAIN not in zones and unmarked.any():
        shares = [(now & unmarked).sum() / unmarked.sum() for now in found]
        near = [s < 1 and s < COPY_SHARE for s in shares]
        # A whole copy says nothing about its template; a near copy does not where the other neighbour can.
        found = [now for now, s in zip(found, shares, strict=True) if s < 1 and (s < COPY_SHARE or not any(near))]
    shared = np.any(found, axis=0) if found else np.zeros(len(lines), bool)
    verdicts = iter((unmarked & ~shared).tolist())
    return [z == MAIN or next(verdicts) for z in zones]


def _difference_task(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(2, 6)]
        keep = [kept_blocks(zones, own, beside) for zones, own, *beside in zip(*columns, strict=True)]
        yield pa.record_batch([*batch.columns[:2], pa.array(keep, pa.list_(pa.bool_()))], names=["k1", "k2", "keep"])


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, n_blocks and n_deleted (lines shared or marked as noise).

    Blocks are texts between block-level tags, with character references decoded and
    white space turned into single blanks; they are joined by two line ends in page
    order. A null or empty html gives an empty text. Without `article` or `main`,
    all unmarked lines that no neighbour shares are the text. A neighbour with all lines of
    the page is a copy and deletes nothing; nor does one that shares most of them, if the
    other neighbour shares less. Two such neighbours, or a lone one, are template. Null urls form a host of their
    own; pages of equal paths are ordered by their whole urls. Repeated rows stay as
    rows and are one page for their neighbours. Extra columns are ignored; an empty table gives no rows.

    Pages are read twice, for lines and for texts: this costs less than keeping texts
    until the lines are compared.
    """
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", url.alias("url"), F.col("html").cast("string").alias("html"))
    # Two hashes name a page; together they do not collide.
    keys = [F.xxhash64(F.lit(k), "page_id", "url", "html").alias(f"k{k}") for k in (1, 2)]
    lines = rows.select(*keys, "url", "html").mapInArrow(
        _lines_task, "k1 long, k2 long, url string, zones array<byte>, lines array<long>"
    )
    distinct = lines.select("k1", "k2", host.alias("host"), path.alias("path"), "url", "zones", "lines")
    placed = in_range_order(
        distinct.dropDuplicates(["k1", "k2"]),
        ["host"],
        [F.col("path"), F.col("url"), F.col("k1"), F.col("k2")],
        "place",
    )
    placed = stored(placed.select("k1", "k2", "host", "place", "zones", "lines"))
    before = placed.select("host", (F.col("place") + 1).alias("place"), F.col("lines").alias("before"))
    after = placed.select("host", (F.col("place") - 1).alias("place"), F.col("lines").alias("after"))
    beside = placed.join(before, ["host", "place"], "left").join(after, ["host", "place"], "left")
    keep = stored(
        beside.select("k1", "k2", "zones", "lines", "before", "after").mapInArrow(
            _difference_task, "k1 long, k2 long, keep array<boolean>"
        )
    )
    kind = rows.schema["page_id"].dataType.simpleString()
    parsed = rows.select(*keys, "url", "page_id", "html").mapInArrow(
        _blocks_task, f"k1 long, k2 long, url string, page_id {kind}, blocks array<string>"
    )
    texts = F.filter("blocks", lambda block, i: F.get("keep", i))
    found = parsed.join(keep, ["k1", "k2"]).select("page_id", "url", "blocks", texts.alias("texts"))
    found = found.select(
        "page_id",
        "url",
        F.array_join("texts", "\n\n").alias("text"),
        F.size("blocks").cast("long").alias("n_blocks"),
        (F.size("blocks") - F.size("texts")).cast("long").alias("n_deleted"),
    )
    return found.select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_deleted"
    )
