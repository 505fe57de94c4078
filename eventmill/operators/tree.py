"""Page html -> element tree, the one step that needs Python (H1, H2).

The standard library reads the tags; this module only numbers the elements and
notes who encloses whom. What the numbers are used for is Spark's business:
see ``shape`` and ``extractors``. Everything is linear in the page: the
pointers `up` are inherited on the way down, `first` and the section bounds are
filled in when an element closes.
"""

from __future__ import annotations

import gc
import html as html_lib
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventmill.schema import FIRST, NODE_INTS, PAGE_TREE, UP

# Subtrees that never count as page content.
IGNORED = frozenset(["script", "style", "noscript", "svg"])
# Text kept apart from the text of the surrounding element.
SIDE_TEXT = frozenset(["template", "rt", "rp"])
# Elements that cannot have content.
VOID = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
HEADINGS = ("h1", "h2", "h3")
WRAPPER = re.compile(r"\b(?:article-card-wrapper|card-wrapper)\b")
CARD = re.compile(r"\bcard\b")
BLURB = re.compile(r"\bcard-description\b")
BODY = re.compile(r"\b(?:content-main|rte)\b")
LINK, IMAGE, ALT, BLURB_MARK = range(len(FIRST))
# Elements whose text is not read together with their tags.
NO_LEAF = VOID | IGNORED | SIDE_TEXT
NO_POINTERS = (0, 0, 0, 0)
NO_ATTRS: dict[str, str] = {}


class _Open:
    """An element whose end tag has not been seen yet."""

    __slots__ = ("tag", "row", "node_id", "inner", "first", "kids", "depth")

    def __init__(self, tag, row, node_id, inner, depth):
        self.tag = tag
        self.row = row  # index into the batch columns, -1 for root and muted
        self.node_id = node_id
        self.inner = inner  # the `up` pointers its children inherit
        self.first = NO_POINTERS
        self.kids = []
        self.depth = depth


# Tags written plainly, which most are, and the text before them: read here, all else by the library.
# An element that holds text alone is read at once, up to the end of its end tag.
PLAIN = re.compile(
    r"""([^<&]*+)<(?:/([a-z][a-z0-9]*+)>|([a-z][a-z0-9]*+)((?:\s[a-z-]+=(?:"[^"<>&]*"|'[^'<>&]*'))*+)>(?:([^<&]*+)</\3>)?)"""
)
PLAIN_ATTR = re.compile(r'\s([a-z-]+)="([^"]*)"')
QUOTED_ATTR = re.compile(r"""\s([a-z-]+)=(?:"([^"]*)"|'([^']*)')""")

# Places of the values in an element's row.
ROW = [*NODE_INTS, "tag", "up", "first"]
END_ID, RUN_LO, RUN_N = ROW.index("end_id"), ROW.index("run_lo"), ROW.index("run_n")
KID_POS, SEC_LO, SEC_END = ROW.index("kid_pos"), ROW.index("sec_lo"), ROW.index("sec_end")
TAG, FIRST_IN = ROW.index("tag"), ROW.index("first")


class TreeBatch(HTMLParser):
    """The trees of one slice of pages."""

    def __init__(self):
        self.rows: list[list] = []  # one per element, in the order of ROW
        self.attr_keys: list[str] = []
        self.attr_values: list[str] = []
        self.attr_ends = [0]
        self.runs: list[str] = []
        self.kids: list[int] = []
        self.node_ends, self.run_ends, self.kid_ends = [0], [0], [0]
        self.errors: list[str | None] = []
        super().__init__(convert_charrefs=False)

    # -- one page -----------------------------------------------------------
    def add(self, text: str | None) -> None:
        self.reset()
        self.buf: list[str] = []
        self.muted = self.aside = 0
        self.open_count: dict[str, int] = {}
        self.stack = [_Open("", -1, 0, (0, 0, 0, 0), 0)]
        self.node_base, self.run_base, self.kid_base = len(self.rows), len(self.runs), len(self.kids)
        error = None
        if text is None:
            error = "page has no html"
        else:
            self.page_size = len(text)
            try:
                self.feed(text)
                self.close()
                self._flush()
                while self.stack:
                    self._shut(self.stack.pop())
            except Exception as exc:  # a bad page is reported, never fatal
                error = f"{type(exc).__name__}: {exc}"
        if error:
            self._forget_page()
        self.errors.append(error)
        self.node_ends.append(len(self.rows))
        self.run_ends.append(len(self.runs))
        self.kid_ends.append(len(self.kids))

    def _forget_page(self) -> None:
        del self.rows[self.node_base :]
        del self.attr_ends[self.node_base + 1 :]
        del self.attr_keys[self.attr_ends[-1] :]
        del self.attr_values[self.attr_ends[-1] :]
        del self.runs[self.run_base :]
        del self.kids[self.kid_base :]

    # -- text ---------------------------------------------------------------
    def handle_data(self, data):
        if not self.muted and not self.aside:
            self.buf.append(data)

    def handle_entityref(self, name):
        known = html5.get(name + ";") or html5.get(name)
        self.handle_data(known or "&" + name)

    def handle_charref(self, name):
        self.handle_data(html_lib.unescape(f"&#{name};"))

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.handle_data(data[6:])
            self._flush()

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = handle_comment

    def _flush(self):
        if self.buf:
            # Whitespace is collapsed here once, so no later step has to.
            text = " ".join("".join(self.buf).split())
            self.buf.clear()
            if text:
                self.runs.append(text)

    # -- tags ---------------------------------------------------------------
    def updatepos(self, i, j):
        return j  # lines are not counted, see _position

    def parse_starttag(self, i):
        k = self._plain_tags(i)
        if k > i:
            return k
        self.tag_at = i
        return super().parse_starttag(i)

    def parse_endtag(self, i):
        k = i if self.cdata_elem else self._plain_tags(i)
        return k if k > i else super().parse_endtag(i)

    def _plain_tags(self, i):
        """Read plain tags, and the text between them, from place `i` on; the place behind them.

        One loop without a call per tag; what it does is what the handlers below do.
        """
        raw, rows, runs, buf, stack = self.rawdata, self.rows, self.runs, self.buf, self.stack
        open_count, attr_ends, attr_keys = self.open_count, self.attr_ends, self.attr_keys
        node_base, run_base = self.node_base, self.run_base
        before, unread = self.page_size - len(raw), self.CDATA_CONTENT_ELEMENTS
        read = PLAIN.match
        while (tag_read := read(raw, i)) is not None:
            text, closed, tag, attrs, leaf = tag_read.groups()
            if tag in unread:
                break
            i = tag_read.end()
            if leaf is not None and (self.muted or self.aside or tag in NO_LEAF):
                # The start tag alone; what is inside comes with the next one.
                leaf, i = None, tag_read.start(5)
            if text and not self.muted and not self.aside:
                buf.append(text)
            if self.muted or tag in IGNORED:
                if tag is None:
                    self.handle_endtag(closed)
                else:
                    self.handle_starttag(tag, ())
                continue
            if buf:
                # Whitespace is collapsed here once, so no later step has to.
                text = " ".join("".join(buf).split())
                buf.clear()
                if text:
                    runs.append(text)
            if tag is None:
                top = stack[-1]
                if top.tag == closed and top.row >= 0 and closed not in SIDE_TEXT:
                    stack.pop()
                    open_count[closed] -= 1
                    row = rows[top.row]
                    row[END_ID] = len(rows) - node_base
                    row[RUN_N] = len(runs) - run_base - row[RUN_LO] + 1
                    if top.first is not NO_POINTERS:
                        row[FIRST_IN] = top.first
                    if top.kids:
                        self._seat(top.kids)
                else:
                    self.handle_endtag(closed)
                continue
            parent = stack[-1]
            row, kids, depth, inner = len(rows), parent.kids, parent.depth + 1, parent.inner
            node_id = row - node_base + 1
            kids.append(row)
            at = before + tag_read.start(3) if tag == "a" else 0
            run = len(runs) - run_base + 1
            rows.append([node_id, node_id, parent.node_id, len(kids), depth, run, 0, 0, 0, 0, at, tag, inner, NO_POINTERS])
            css = None
            if attrs:
                if "'" in attrs:
                    kept = {k: v or w for k, v, w in QUOTED_ATTR.findall(attrs)}
                else:
                    kept = dict(PLAIN_ATTR.findall(attrs))
                attr_keys.extend(kept)
                self.attr_values.extend(kept.values())
                self._mark(tag, kept, node_id)
                css = kept.get("class")
            elif tag == "img":
                self._mark(tag, NO_ATTRS, node_id)
            attr_ends.append(len(attr_keys))
            if leaf is not None:
                leaf = " ".join(leaf.split())
                if leaf:
                    runs.append(leaf)
                    rows[row][RUN_N] = 1
            elif tag not in VOID:
                if css or tag == "article":
                    inner = self._enclosing(tag, css, node_id, inner)
                stack.append(_Open(tag, row, node_id, inner, depth))
                open_count[tag] = open_count.get(tag, 0) + 1
                if tag in SIDE_TEXT:
                    self.aside += 1
        return i

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        if self.buf:
            self._flush()
        parent = self.stack[-1]
        if self.muted or tag in IGNORED:
            if tag not in VOID:
                self.muted += 1
                self._push(_Open(tag, -1, 0, parent.inner, 0))
            return
        kept = {k: v or "" for k, v in attrs} if attrs else NO_ATTRS
        row = len(self.rows)
        node_id = row - self.node_base + 1
        kids = parent.kids
        kids.append(row)
        depth = parent.depth + 1
        # The zeros are filled in when the element or its parent closes.
        self.rows.append(
            [
                node_id,
                node_id,
                parent.node_id,
                len(kids),
                depth,
                len(self.runs) - self.run_base + 1,
                0,
                0,
                0,
                0,
                self._position() if tag == "a" else 0,
                tag,
                parent.inner,
                NO_POINTERS,
            ]
        )
        if kept:
            self.attr_keys.extend(kept)
            self.attr_values.extend(kept.values())
            self._mark(tag, kept, node_id)
        elif tag == "img":
            self._mark(tag, kept, node_id)
        self.attr_ends.append(len(self.attr_keys))
        if tag not in VOID:
            inner = parent.inner
            css = kept.get("class")
            if css or tag == "article":
                inner = self._enclosing(tag, css, node_id, inner)
            self._push(_Open(tag, row, node_id, inner, depth))

    def handle_endtag(self, tag):
        if self.buf:
            self._flush()
        if self.open_count.get(tag):
            while True:
                top = self.stack.pop()
                self.open_count[top.tag] -= 1
                self._shut(top)
                if top.tag == tag:
                    break

    def _push(self, element):
        self.stack.append(element)
        tag = element.tag
        self.open_count[tag] = self.open_count.get(tag, 0) + 1
        if tag in SIDE_TEXT:
            self.aside += 1

    def _shut(self, element):
        if element.tag in SIDE_TEXT:
            self.aside -= 1
        if element.row >= 0:
            row = self.rows[element.row]
            row[END_ID] = len(self.rows) - self.node_base
            row[RUN_N] = len(self.runs) - self.run_base - row[RUN_LO] + 1
            if element.first is not NO_POINTERS:
                row[FIRST_IN] = element.first
        elif element.tag:
            self.muted -= 1
        if element.kids:
            self._seat(element.kids)

    def _seat(self, family):
        """Give the children of one parent their places and section bounds."""
        place = lo = len(self.kids) - self.kid_base + 1
        end = place + len(family)
        all_rows = self.rows
        rows = [all_rows[r] for r in family]
        for row in rows:
            row[KID_POS] = place
            row[SEC_LO] = lo
            row[SEC_END] = end
            place += 1
            if row[TAG] in HEADINGS:
                lo = place
        if lo > rows[0][SEC_LO]:  # headings, which end the sections before them
            for row in reversed(rows):
                row[SEC_END] = end
                if row[TAG] in HEADINGS:
                    end = row[KID_POS]
        self.kids.extend([row[0] for row in rows])

    def _mark(self, tag, kept, node_id):
        if tag == "a":
            marks = (LINK,) if "href" in kept else ()
        elif tag == "img":
            marks = (IMAGE, ALT) if "alt" in kept else (IMAGE,)
        else:
            marks = ()
        css = kept.get("class")
        if css and BLURB.search(css):
            marks += (BLURB_MARK,)
        for mark in marks:
            # An element that has a first X implies that all around it have one.
            for element in reversed(self.stack):
                if element.first[mark]:
                    break
                if element.first is NO_POINTERS:
                    element.first = [0, 0, 0, 0]
                element.first[mark] = node_id

    @staticmethod
    def _enclosing(tag, css, node_id, inherited):
        article, wrapper, card, body = inherited
        if tag == "article":
            article = node_id
        if css:
            if WRAPPER.search(css):
                wrapper = node_id
            if CARD.search(css):
                card = node_id
            if tag == "div" and BODY.search(css):
                body = node_id
        found = (article, wrapper, card, body)
        return inherited if found == inherited else found

    def _position(self):
        """1-based character position of the current tag in the page."""
        return self.page_size - len(self.rawdata) + self.tag_at + 1

    # -- Arrow --------------------------------------------------------------
    def to_arrow(self) -> pa.StructArray:
        int32, text = pa.int32(), pa.string()

        def pointers(names, rows):
            columns = zip(*rows) if rows else [[] for _ in names]
            return pa.StructArray.from_arrays([pa.array(c, int32) for c in columns], list(names))

        columns = list(zip(*self.rows)) if self.rows else [()] * len(ROW)
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_ends, int32),
            pa.array(self.attr_keys, text),
            pa.array(self.attr_values, text),
        )
        node = pa.StructArray.from_arrays(
            [pa.array(c, int32) for c in columns[: len(NODE_INTS)]]
            + [
                pa.array(columns[TAG], text),
                attrs,
                pointers(UP, columns[TAG + 1]),
                pointers(FIRST, columns[FIRST_IN]),
            ],
            [*NODE_INTS, "tag", "attrs", "up", "first"],
        )
        return pa.StructArray.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(self.node_ends, int32), node),
                pa.ListArray.from_arrays(
                    pa.array(self.run_ends, int32), pa.array(self.runs, text)
                ),
                pa.ListArray.from_arrays(pa.array(self.kid_ends, int32), pa.array(self.kids, int32)),
                pa.array(self.errors, text),
            ],
            ["nodes", "runs", "kids", "error"],
        )


#: Pages, and characters of html, whose trees a task holds at once.
SLICE_PAGES, SLICE_CHARS = 256, 1 << 20


def tree_slices(pages: pa.Array) -> Iterator[pa.Array]:
    """Trees of a batch, a slice of pages at a time: a tree takes many times the room of
    its page, so what a task holds follows from the slice and not from Spark's batch."""
    batch, count, chars = TreeBatch(), 0, 0
    # The rows of a slice all live until its end: nothing to collect before.
    gc.disable()
    try:
        for page in pages:
            text = page.as_py()
            batch.add(text)
            count, chars = count + 1, chars + len(text or "")
            if count == SLICE_PAGES or chars >= SLICE_CHARS:
                done, batch, count, chars = batch.to_arrow(), TreeBatch(), 0, 0
                yield done
        if count or not len(pages):
            yield batch.to_arrow()
    finally:
        gc.enable()


@F.arrow_udf(returnType=PAGE_TREE)
def _page_tree(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield from tree_slices(pages)


# Marked so that the optimizer reads each page once: it would otherwise move a
# filter on `error` below a join and read the pages there a first time.
_page_tree = _page_tree.asNondeterministic()


def page_tree(html: Column) -> Column:
    """Tree of one page: struct<nodes, runs, kids, error>."""
    return _page_tree(html)


def with_tree(pages: DataFrame) -> DataFrame:
    """Add `nodes`, `runs`, `kids`, `error` to a pages table.

    A row-wise column, so the partitioning of `pages` is kept and no shuffle is
    needed to work on whole pages afterwards.
    """
    return pages.withColumn("_tree", page_tree(F.col("html"))).select(
        *pages.columns, "_tree.nodes", "_tree.runs", "_tree.kids", "_tree.error"
    )
