"""The page tree against a plain reading of the same pages."""

import random
import re
from html.parser import HTMLParser

import pyarrow as pa

from eventmill.operators import tree
from eventmill.operators.tree import TreeBatch

HEADINGS = ("h1", "h2", "h3")


def read(*pages):
    batch = TreeBatch()
    for page in pages:
        batch.add(page)
    return batch.to_arrow().to_pylist()


def texts(page):
    return {
        n["tag"] + str(n["node_id"]): " ".join(page["runs"][n["run_lo"] - 1 :][: n["run_n"]])
        for n in page["nodes"]
    }


def test_open_paragraphs_nest_and_bare_text_stays_with_the_parent():
    (page,) = read("<p>a<b>c<br><p>d</p>e<h1>f</h1>g")
    assert [(n["tag"], n["parent_id"]) for n in page["nodes"]] == [
        ("p", 0), ("b", 1), ("br", 2), ("p", 2), ("h1", 2),
    ]
    assert page["runs"] == ["a", "c", "d", "e", "f", "g"]
    assert texts(page)["p1"] == "a c d e f g"
    assert texts(page)["p4"] == "d"


def test_ignored_subtrees_comments_and_references():
    (page,) = read(
        "x<script>if (a<b) {'</p>'}</script>y<svg><h1>no</h1></svg>&amp;&eacute;&#8217;&bogus;&copy z"
        "<!-- no --><noscript><a href='/no'></a></noscript><template><p>no</p></template>"
    )
    assert page["runs"] == ["x", "y", "&é’&bogus© z"]
    assert [n["tag"] for n in page["nodes"]] == ["template", "p"]


def test_end_tags_close_the_nearest_of_their_name_or_nothing():
    (page,) = read("<div><p><i>a</div>b</i></p><br></br><p/>c")
    assert [(n["tag"], n["parent_id"], n["end_id"]) for n in page["nodes"]] == [
        ("div", 0, 3), ("p", 1, 3), ("i", 2, 3), ("br", 0, 4), ("p", 0, 5),
    ]


def test_a_page_without_html_is_an_error_of_its_own():
    good, bad, last = read("<p>a</p>", None, "<p>b</p>")
    assert bad == {"nodes": [], "runs": [], "kids": [], "error": "page has no html"}
    assert (good["error"], last["error"]) == (None, None)
    assert last["runs"] == ["b"]


def test_a_failing_page_leaves_no_trace(monkeypatch):
    original = TreeBatch.handle_comment

    def fail(self, data):
        raise ValueError("broken")

    monkeypatch.setattr(TreeBatch, "handle_comment", fail)
    pages = read("<p>a</p>", "<p>lost<a href='x'>y</a><!-- c -->", "<a href='z'>b</a>")
    monkeypatch.setattr(TreeBatch, "handle_comment", original)
    assert pages[1] == {"nodes": [], "runs": [], "kids": [], "error": "ValueError: broken"}
    assert pages[2]["runs"] == ["b"] and dict(pages[2]["nodes"][0]["attrs"]) == {"href": "z"}


BITS = """<p>|</p>|<a href='x'>|<a href="y&amp;" class="card b">|</a>|<br/>|<br>|</br>|text &amp; x|<h2>
</h2>|<div class=card-description>|</div>|<!-- c -->|<script>if(a<b)</script>|<svg><g>|</svg>|<h1>|</h1>
<img src=q alt=>|<img>|<![CDATA[x]]>|<?pi?>|< p|<P CLASS="Rte">|</P >|<article class="eventlist-event">
</article>|<a\thref="q">|<div class="rte" class="x">|<li>|<style>p{}</style>|<a href="z"
<section class="card-wrapper">|</section>|&#8217;|&bogus; |<template>z|</template>""".replace("\n", "|").split("|")


def random_pages(n):
    rng = random.Random(1)
    return ["".join(rng.choices(BITS, k=rng.randint(1, 40))) for _ in range(n)]


def test_plain_tags_are_read_as_the_library_reads_them(monkeypatch):
    pages = random_pages(1500)
    fast = read(*pages)
    monkeypatch.setattr(TreeBatch, "parse_endtag", HTMLParser.parse_endtag)

    def slow(self, i):
        self.tag_at = i
        return HTMLParser.parse_starttag(self, i)

    monkeypatch.setattr(TreeBatch, "parse_starttag", slow)
    assert read(*pages) == fast


def css(n):
    return dict(n["attrs"]).get("class", "")


def test_pointers_against_brute_force():
    first_tests = {
        "link": lambda n: n["tag"] == "a" and "href" in dict(n["attrs"]),
        "image": lambda n: n["tag"] == "img",
        "alt": lambda n: n["tag"] == "img" and "alt" in dict(n["attrs"]),
        "blurb": lambda n: re.search(r"\bcard-description\b", css(n)),
    }
    up_tests = {
        "article": lambda n: n["tag"] == "article",
        "wrapper": lambda n: tree.WRAPPER.search(css(n)),
        "card": lambda n: tree.CARD.search(css(n)),
        "body": lambda n: n["tag"] == "div" and tree.BODY.search(css(n)),
    }
    for page in read(*random_pages(400)):
        nodes, kids = page["nodes"], page["kids"]
        for n in nodes:
            family = [m for m in nodes if m["parent_id"] == n["parent_id"]]
            at = n["sib_ord"] - 1
            assert family[at] is n
            after, before = [], []
            for stretch, around in ((after, family[at + 1 :]), (before, family[:at][::-1])):
                for m in around:
                    if m["tag"] in HEADINGS:
                        break
                    stretch.append(m["node_id"])
            assert kids[n["kid_pos"] : n["sec_end"] - 1] == after
            assert kids[n["sec_lo"] - 1 : n["kid_pos"] - 1] == before[::-1]
            inside = [m for m in nodes if n["node_id"] < m["node_id"] <= n["end_id"]]
            around = [m for m in nodes if m["node_id"] < n["node_id"] <= m["end_id"]]
            for name, test in first_tests.items():
                assert n["first"][name] == next((m["node_id"] for m in inside if test(m)), 0)
            for name, test in up_tests.items():
                assert n["up"][name] == next((m["node_id"] for m in around[::-1] if test(m)), 0)


def test_trees_of_a_batch_come_in_slices_of_bounded_size(monkeypatch):
    pages = [f"<h1>t{i}</h1><p class='c'>{'x' * (i % 7)}</p>" if i % 11 else None for i in range(100)]
    whole = read(*pages)
    monkeypatch.setattr(tree, "SLICE_PAGES", 16)
    monkeypatch.setattr(tree, "SLICE_CHARS", 200)
    slices = list(tree.tree_slices(pa.array(pages)))
    assert [p for s in slices for p in s.to_pylist()] == whole
    assert max(len(s) for s in slices) <= 16 and len(slices) > 100 // 16
    assert [len(s) for s in tree.tree_slices(pa.array([], pa.string()))] == [0]
    # One page beyond the bound is a slice of its own.
    assert [len(s) for s in tree.tree_slices(pa.array(["y" * 300, "z"]))] == [1, 1]


def test_a_run_of_plain_tags_takes_no_call_per_tag(monkeypatch):
    page = "<body>" + "<p class='c'><a href=\"/x\">t</a> u</p>" * 50 + "</body>"
    calls = []
    for name in ("handle_starttag", "handle_endtag"):
        original = getattr(TreeBatch, name)
        monkeypatch.setattr(TreeBatch, name, lambda self, *a, f=original: (calls.append(a[0]), f(self, *a)))
    (tree_read,) = read(page)
    assert calls == []
    assert len(tree_read["nodes"]) == 101 and tree_read["runs"] == ["t", "u"] * 50
    assert dict(tree_read["nodes"][1]["attrs"]) == {"class": "c"}
    assert page[tree_read["nodes"][2]["html_pos"] - 1 :].startswith("<a href")


def test_an_element_of_text_alone_is_read_at_once():
    for page in ("<li>one two</li>", '<a href="/x"></a>', "b <h2 class='card'>c\n</h2>"):
        assert tree.PLAIN.match(page).end() == len(page)
    (page,) = read("<ul><li>a  b</li><li></li>c</ul><template><p>d</p></template><svg><p>e</p></svg><rt>f</rt><br>g</br>")
    assert [(n["tag"], n["end_id"], n["run_n"]) for n in page["nodes"]] == [
        ("ul", 3, 2), ("li", 2, 1), ("li", 3, 0), ("template", 5, 0), ("p", 5, 0), ("rt", 6, 0), ("br", 7, 0),
    ]
    assert page["runs"] == ["a b", "c", "g"]
