import random
import time

import pytest

from eventmill.llm import html_text

SCHEMA = "page_id long, url string, html string, text string, keep int, place int"


def run(spark, rows):
    pages = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    return {r.page_id: r for r in html_text.main_text(pages).collect()}


def main(html):
    blocks, zones = html_text.page_blocks(html)
    return "\n\n".join(b for b, z in zip(blocks, zones, strict=True) if z == html_text.MAIN)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>A &amp; B</h1><p>x<br>y <b>z</b>w<p>two\n\t lines</article>", "A & B\n\nx y zw\n\ntwo lines"),
        ("<nav>n</nav><article><p>a</p><div class='ad'>ad</div><p>b</p></article><footer>f</footer>", "a\n\nb"),
        ("<article><p>a<script>var t='</p>';</script>b</p><style>p{}</style><!-- c <p>d --></article>", "ab"),
        ("<main><header><h1>T</h1></header><p title=\"a>b\">x</p><aside>s</aside></main>", "T\n\nx"),
        ("<article><p>a</p><section id=comments><article><p>c</p></article></section><p>b</p></article>", "a\n\nb"),
        ("<article><p class='notice'>n</p><p>a</p><form><p>f</p></form><li class=share>s<li>b</article>", "a\n\nb"),
        ("<ARTICLE><P>1 &lt; 2 &#233; &eacute;&nbsp;&notit;</ARTICLE>", "1 < 2 é é ¬it;"),
        ("<article><p>a</b></i></p></div>b<p>c", "a\n\nb\n\nc"),
        ("<article><p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"),
        ("<article><p>it=\"s <b class=don't>x</b> it's</p></article>", "it=\"s x it's"),
        ("<article><p>a</p><textarea><p>t</p></textarea><title>x</title><template><p>u</p></template></article>", "a"),
        ("", ""), (None, ""), ("<article>", ""), ("<script>x", ""), ("plain words", ""),
    ],
)
def test_article_text(html, text):
    assert main(html) == text


def test_lines_that_neighbours_share_are_deleted(spark):
    site = "<div>Welcome to us</div><p>{}</p><p>{} more</p><div>Made with care</div>"
    rows = [(i, f"https://s.net/a/{i}", site.format(f"text {i}", f"other {i}")) for i in range(4)]
    rows += [(10, "https://alone.net/", site.format("one", "two"))]
    found = run(spark, rows)
    assert all(found[i].text == f"text {i}\n\nother {i} more" for i in range(4))
    assert found[10].text == "Welcome to us\n\none\n\ntwo more\n\nMade with care"
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_copies_and_articles_are_protected(spark):
    copy = "<p>first line</p><p>second line</p><p>third line</p>"
    article = "<div>Site</div><article><p>same words</p><p>everywhere</p></article>"
    rows = [(1, "https://c.net/1", copy), (2, "https://c.net/2", copy), (3, "https://d.net/1", article), (4, "https://d.net/2", article)]
    found = run(spark, rows)
    assert found[1].text == found[2].text == "first line\n\nsecond line\n\nthird line"
    assert found[3].text == found[4].text == "same words\n\neverywhere"


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, "<article>x</article>"), (1, "http://a.org/", ""), (2, "nothing", "<p>y")]
    pages = spark.createDataFrame([(*r, "x", 1, 2) for r in rows] * 2, SCHEMA)
    found = html_text.main_text(pages).collect()
    assert len(found) == 8 and sorted(r.text for r in found) == ["", "", "", "", "x", "x", "y", "y"]
    assert html_text.main_text(pages.limit(0)).collect() == []


def test_common_lines_are_a_longest_common_subsequence():
    draw = random.Random(4)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(300):
        a = [draw.randrange(6) for _ in range(draw.randrange(30))]
        b = [draw.randrange(6) for _ in range(draw.randrange(30))]
        found = html_text.common_lines(a, b)
        assert found == sorted(set(found)) and len(found) == longest(a, b)
        rest = iter(b)
        assert all(any(y == a[i] for y in rest) for i in found)
    long = [draw.randrange(3000) for _ in range(4000)]
    other = [x for x in long if draw.random() < 0.7]
    assert len(html_text.common_lines(long, other)) == len(other)


def test_pages_of_the_given_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for r in pages.collect():
        inside = r.html.split("<article>")[1].split("</article>")[0]
        assert found[r.page_id] == main(f"<article>{inside}</article>")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article class="post comments-open"><p>a</article>', "a"),
        ('<div class="layout has-sidebar"><article><p>a</article></div>', "a"),
        ('<main id="content-social"><p>a</main>', "a"),
        ('<article><section class="no-widget"><p>a</section></article>', "a"),
        ('<div class="social"><div><article><p>a<p class=share>s</article></div>x</div>', "a"),
        ('<div class="widget"><nav>n</nav><main><p>a</main><p>w</div>', "a"),
        ('<div class="widget"><div class="menu"><nav>n</nav></div><article><p>a</article></div>', "a"),
        ('<article><p>a</article><div id="comments"><article><p>c</article></div>', "a"),
        ('<div class="widget"><aside><article><p>c</article></aside></div><p>b', ""),
        ('<article><p>a<div class="newsletter-box"><p>n</div><div class="cookie consent">c</div></article>', "a"),
    ],
)
def test_classes_are_hints(html, text):
    assert main(html) == text


def plain_page(own, menu):
    return "<body>" + "".join(f"<p>{x}</p>" for x in [*menu, *own]) + "</body>"


def test_a_menu_that_is_most_of_a_page_goes(spark):
    """Pages without article, of nine lines of menu and one of their own."""
    menu = [f"Menu {i}" for i in range(9)]
    pages = [(i, f"https://e.org/{i}", plain_page([f"Own text {i}"], menu)) for i in range(5)]
    pages += [(10 + i, f"https://alone{i}.org/", plain_page([], ["Same line", "and text"])) for i in range(2)]
    pages += [(20 + i, f"https://copy.org/{i}", plain_page(["One", "copied", "page"], [])) for i in range(3)]
    found = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [found[i] for i in range(5)] == [f"Own text {i}" for i in range(5)]
    assert found[10] == "Same line\n\nand text" and found[20] == "One\n\ncopied\n\npage"


def test_kept_blocks_equal_brute_force():
    draw = random.Random(5)
    for _ in range(400):
        zones = [draw.choice([html_text.MAIN] * draw.choice([0, 1]) + [html_text.NOISE, html_text.OPEN]) for _ in range(draw.randrange(9))]
        lines = [draw.randrange(6) for z in zones if z != html_text.MAIN]
        beside = [draw.choice([None, [], [draw.randrange(6) for _ in range(draw.randrange(9))]]) for _ in range(2)]
        unmarked = [z == html_text.OPEN for z in zones if z != html_text.MAIN]
        shared = []
        for other in beside:
            if other and lines:
                shared.append({k for k in html_text.common_lines(lines, other)})
        if html_text.MAIN not in zones and any(unmarked):
            share = [sum(unmarked[k] for k in s) / sum(unmarked) for s in shared]
            lower = any(x < 0.8 for x in share)
            shared = [s for s, x in zip(shared, share) if x < 1 and (x < 0.8 or not lower)]
        gone = set().union(*shared)
        want, k = [], 0
        for z in zones:
            if z == html_text.MAIN:
                want.append(True)
            else:
                want.append(unmarked[k] and k not in gone)
                k += 1
        assert html_text.kept_blocks(zones, lines, beside) == want


@pytest.mark.parametrize("name", ["post-comments", "related-posts", "user-comment", "entry-comments", "cookie-law", "share-this",
                                  "ad-300x250", "adsbygoogle", "google-ads", "main-nav"])
def test_tokens_with_a_noise_word(name):
    html = f'<body><article><p>Text</p><section class="{name}"><p>Noise</p></section></article><div class="{name}">More</div></body>'
    blocks, zones = html_text.page_blocks(html)
    assert [b for b, z in zip(blocks, zones) if z == html_text.MAIN] == ["Text"]
    assert html_text.OPEN not in zones


@pytest.mark.parametrize("piece", ["<a ", "<a x=", '<a x="', "<script ", "<!-- ", "</b ", "< ", "<a b='", "="])
def test_unclosed_tails_are_linear(piece):
    started = time.process_time()
    html_text.page_blocks("<p>Text</p>" + piece * (1_000_000 // len(piece)))
    html_text.page_blocks("<p>Text</p>" + piece * (500_000 // len(piece)) + 'x=">"')
    assert time.process_time() - started < 10


def test_an_unclosed_tag_ends_the_text():
    assert html_text.page_blocks("<p>One</p> two <a href='x'")[0] == ["One", "two"]
