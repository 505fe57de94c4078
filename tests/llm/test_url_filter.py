import math
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from eventmill.llm import url_filter

SCHEMA = "page_id long, url string, host string, rule string, template int"
URLS = [
    None, "", "no scheme", "http://", "https://Example.ORG", "https://example.org/", "https://a.example.org/es/x",
    "https://example.org/es", "https://example.org/en/1", "https://example.org/en/123?x=/en", "https://notexample.org/en/1",
    "http://x.com/fr/", "http://X.COM/de/1#a", "http://com/fr/2", "http://telecom/fr/2", "http://a.net/fr/2?u=http://b.org/",
    "ftp://u@h.org:80/p", "http://h.org?x", "http://h.org#/x", "mailto:x@y.org", "a://b://c.org/d", "http://é.org/ü",
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1])) if fits else None
    return host, path, best


def table(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", 1) for r in rows], SCHEMA)


def no_labels(spark):
    return spark.createDataFrame([], "page_id long, bad boolean")


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(None, "http://x.com/fr/"), (0, None), (0, None)]
    found = url_filter.judge(table(spark, rows), no_labels(spark)).collect()
    assert len(found) == len(rows)
    want = sorted((str(i), *judged(u)[:2], str(judged(u)[2] and "".join(judged(u)[2][:2]))) for i, u in rows)
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in found) == want
    for r in found:
        best = judged(dict(enumerate(URLS)).get(r.page_id) if r.page_id is not None else "http://x.com/fr/")[2]
        assert r.verdict == (best[2] if best else "allow")


def test_bad_branches_are_blocked_and_similar_ones_merged(spark):
    rows, labels = [], []
    for i in range(600):
        branch = ["news", "blog", "casino"][i % 3]
        rows.append((i, f"https://site.net/{branch}/{i}"))
        labels.append((i, branch == "casino" if i % 10 else branch != "casino"))
    rows += [(1000 + i, f"https://site.net/casino/new-{i}{i}{i}{i}") for i in range(5)]
    rows += [(2000 + i, f"https://other.net/tag{i}") for i in range(30)]
    found = {r.page_id: r for r in url_filter.judge(table(spark, rows), spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert {found[i].verdict for i in range(600) if i % 3 == 2} == {"block"}
    assert {found[i].verdict for i in range(600) if i % 3 < 2} == {"allow"}
    assert found[0].template == found[1].template == "/{blog|news}/*"
    assert found[2].template == "/casino/*"
    assert {found[1000 + i].verdict for i in range(5)} == {"block"}
    assert {found[2000 + i].template for i in range(30)} == {"/*"}


def test_purity_is_smoothed(spark):
    # One bad label is not enough to reject a template.
    rows = [(i, f"https://site.net/{'a' if i else 'b'}/{i}") for i in range(40)]
    labels = [(i, i == 0) for i in range(40)] + [(None, True), (5, None)]
    found = url_filter.judge(table(spark, rows), spark.createDataFrame(labels, "page_id long, bad boolean"))
    assert {r.verdict for r in found.collect()} == {"allow"}


def test_deep_paths_and_empty_table(spark):
    rows = [(1, "https://s.net/" + "/".join("abcdefgh") + "/9"), (2, "https://s.net//x//y/")]
    found = {r.page_id: r for r in url_filter.judge(table(spark, rows), no_labels(spark)).collect()}
    assert found[1].path.endswith("/h/9") and found[2].path == "//x//y/"
    assert url_filter.judge(table(spark, []), no_labels(spark)).collect() == []


def test_oracle_counts_match_templates(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = url_filter.judge(pages, no_labels(spark))
    assert found.count() == pages.count()
    assert found.filter(F.col("verdict").isNull()).count() == 0


def site(sections, page="https://site.net/{}/x{}"):
    """Pages and labels of (section, pages, labels, bad)."""
    rows, labels = [], []
    for name, n_pages, n_labels, bad in sections:
        labels += [(len(rows) + i, bad) for i in range(n_labels)]
        rows += [(len(rows) + i, page.format(name, i)) for i in range(n_pages)]
    return rows, labels


def verdicts(spark, rows, labels):
    found = url_filter.judge(table(spark, rows), spark.createDataFrame(labels, "page_id long, bad boolean")).collect()
    urls = dict(rows)
    return {(urls[r.page_id].rsplit("/", 1)[0], r.verdict) for r in found}, {r.page_id: r for r in found}


def test_siblings_without_labels_bridge_nothing(spark):
    for n_pages in (3, 300):
        rows, labels = site([("news", 200, 200, False), ("about", n_pages, 0, False), ("casino", 200, 200, True)])
        got, found = verdicts(spark, rows, labels)
        assert {("https://site.net/news", "allow"), ("https://site.net/casino", "block")} <= got
        assert len([g for g in got if g[0] != "https://site.net/about"]) == 2
        assert found[0].template == "/news/*"


def test_many_children_and_deep_ones_are_told_apart(spark):
    sections = [(f"part{'abcdefghijklmnopqrstuvwxyz'[i]}", 20, 20, i % 5 == 0) for i in range(25)]
    for page in ("https://site.net/{}/x{}", "https://site.net/a/b/c/d/e/{}/x{}"):
        rows, labels = site(sections, page)
        got, found = verdicts(spark, rows, labels)
        assert got == {(page.format(n, 0).rsplit("/", 1)[0], "block" if bad else "allow") for n, _, _, bad in sections}
        # 20 good children are merged: 16 names are written out.
        assert found[20].template.split("{")[1].count("|") == 16 and "|+4#" in found[20].template


def test_rare_children_are_a_wildcard(spark):
    rows, labels = site([(f"s{'abcdefghij'[i]}", 5, 5, False) for i in range(10)] + [("spam", 50, 50, True)])
    got, found = verdicts(spark, rows, labels)
    assert {r.template.split("{")[0] for r in found.values() if r.page_id < 50} == {"/*/"}
    assert {r.verdict for r in found.values() if r.page_id >= 50} == {"block"}


def plain_templates(pages, bad):
    """{(host, segments): branches per level} and {(host, branches): [good, bad]}, page by page and child by child."""
    counts = defaultdict(lambda: [0, 0, 0])
    for page_id, host, segments in pages:
        c = counts[host, segments]
        c[0] += 1
        for b in bad.get(page_id, []):
            c[1 + b] += 1
    at = {key: () for key in counts}

    def split(prefix, keys, level):
        keys = [k for k in keys if len(k[1]) > level]
        kids = defaultdict(list)
        for k in keys:
            kids[k[1][level]].append(k)
        sums = {s: [sum(counts[k][i] for k in own) for i in range(3)] for s, own in kids.items()}
        named = {s: c for s, c in sums.items() if s != "*" and (c[0] >= 100 or c[1] + c[2] >= 10)}
        branches, good, bad_ = [], 0, 0
        kinds = defaultdict(list)
        for s, (_, g, b) in named.items():
            if g + b >= 10:
                kinds[b / (g + b), g, b].append(s)
        for (share, g, b), names in sorted(kinds.items()):
            n, m = g + b, good + bad_
            opens = not branches
            if m:
                both = (b + bad_) / (n + m)
                spread = math.sqrt(both * (1 - both) * (1 / n + 1 / m))
                opens = spread > 0 and abs(share - bad_ / m) / spread > 2.58
            if opens:
                branches.append([])
                good = bad_ = 0
            branches[-1] += names
            good, bad_ = good + g * len(names), bad_ + b * len(names)
        branches += [[s] for s, (_, g, b) in named.items() if g + b < 10]
        rest = [s for s in kids if s not in named]
        for names in branches + ([rest] if rest else []):
            label = frozenset(["*"]) if names is rest else frozenset(names)
            below = [k for s in names for k in kids[s]]
            for k in below:
                at[k] = (*prefix, label)
            split((*prefix, label), below, level + 1)

    for host in {h for h, _ in counts}:
        split((), [k for k in counts if k[0] == host], 0)
    sums = defaultdict(lambda: [0, 0])
    for key, template in at.items():
        for i in (0, 1):
            sums[key[0], template][i] += counts[key][1 + i]
    return at, sums


def test_trees_and_purity_against_plain_python(spark):
    draw = random.Random(11)
    share = {f"k{'abcdefghijkl'[i]}": p for i, p in enumerate([0, 0, 0.05, 0.1, 0.3, 0.5, 0.55, 0.8, 0.9, 1, 1, 0.2])}
    pages, bad = [], {}
    for i in range(6000):
        host = draw.choice(["a.net", "a.net", "b.net"])
        top = draw.choice(list(share) + ["odd" + draw.choice("abcdefghij") + draw.choice("abcdefghij")])
        segments = [top, draw.choice(["in", "out", "x" + draw.choice("abcdefghijklmnopq")]), *draw.choice([[], ["123"], ["end"]])]
        pages.append((i, host, segments[: draw.randrange(4)]))
        if draw.random() < 0.4:
            p = share.get(top, 0.4) if segments[1] != "out" else 1 - share.get(top, 0.4)
            bad[i] = [draw.random() < p for _ in range(draw.choice([1, 1, 2]))]
    rows = [(i, f"https://{h}/" + "/".join(s)) for i, h, s in pages]
    labels = spark.createDataFrame([(i, b) for i, own in bad.items() for b in own], "page_id long, bad boolean")
    found = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, rules=()).collect()
    shaped = [(i, h, tuple("*" if s == "123" else s for s in segments)) for i, h, segments in pages]
    at, sums = plain_templates(shaped, bad)
    total = [sum(c[i] for c in sums.values()) for i in (0, 1)]
    base = (total[0] + 1) / (sum(total) + 1)
    by_id = {r.page_id: r for r in found}
    assert len(by_id) == len(found) == len(pages)
    names = {}
    for i, host, segments in shaped:
        template, r = at[host, segments], by_id[i]
        own = [sum(c[k] for (h, _), c in sums.items() if h == host) for k in (0, 1)]
        prior = (own[0] + 10 * base) / (sum(own) + 10)
        good, wrong = sums[host, template]
        assert abs(r.purity - (good + 10 * prior) / (good + wrong + 10)) < 1e-9, (segments, r)
        assert r.verdict == ("block" if r.purity < 0.5 else "allow")
        names.setdefault((host, template), set()).add(r.template)
    assert all(len(n) == 1 for n in names.values())
    assert len({(h, *n) for (h, _), n in names.items()}) == len(names) > 20
