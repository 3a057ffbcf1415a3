"""Operators 11 to 13 against brute force and on edge cases."""

import datetime as dt
import hashlib
import html
import math
import random
import re

import pytest

from mnemospark.llm import centroids, funnel, html_article

CLICKS = "click_id long, ts timestamp_ntz, client_id long, kind string, next_view string, us string, tag int"
BASE = dt.datetime(2024, 3, 31, 0, 30)


def _clicks():
    rng = random.Random(7)
    kinds = ["view", "click", "view", "click", "purchase", "signup", "error", "other", None]
    out = []
    for i in range(3000):
        client = rng.choice([1, 1, 1, 2, 3, 4, None])
        ts = BASE + dt.timedelta(seconds=rng.randrange(20_000), microseconds=rng.choice([0, 0, 1, 999_999]))
        out.append((i, None if rng.random() < 0.01 else ts, client, rng.choices(kinds, [9, 9, 9, 9, 9, 2, 1, 1, 1])[0], "clash", "clash", 1))
    out += [(9000 + i, ts, 7, k, "x", "y", 2) for i, (ts, k) in enumerate([
        (BASE, "view"), (BASE, "click"), (BASE + dt.timedelta(hours=1), "click"), (BASE + dt.timedelta(hours=1), "view"), (BASE + dt.timedelta(hours=2), "view"),
        (BASE + dt.timedelta(hours=2, microseconds=1), "purchase"), (BASE + dt.timedelta(hours=2, microseconds=1), "error"), (BASE + dt.timedelta(hours=9), "error")])]
    out += [(9100, dt.datetime(1969, 12, 31, 23, 59, 59), 8, "view", "", "", 0), (9101, dt.datetime(1970, 1, 1, 0, 0, 1), 8, "click", "", "", 0)]
    return out + out[:200]


def _brute(rows):
    events = {(r[2], r[3], r[1]) for r in rows if None not in (r[2], r[3], r[1])}
    by = {}
    for c, k, t in events:
        by.setdefault(c, {}).setdefault(k, []).append(t)
    out = []
    for f in funnel.FUNNELS:
        for c, kinds in by.items():
            n, times = [len(kinds.get(f.steps[0], [])), 0, 0, 0], [[], [], [], []]
            for at in kinds.get(f.steps[0], []):
                for s in range(1, 4):
                    later = [t for t in kinds.get(f.steps[s], []) if t > at]
                    if not later or min(later) - at > dt.timedelta(hours=1) or any(at < t <= min(later) for t in kinds.get(f.without, [])):
                        break
                    n[s] += 1
                    times[s].append((min(later) - at) // dt.timedelta(microseconds=1))
                    at = min(later)
            if n[0]:
                out.append([f.name, c, *n, max(s + 1 for s in range(4) if n[s]), *[sorted(x)[math.ceil(90 * len(x) / 100) - 1] if x else None for x in times[1:]]])
    return [(*r, sum(x[0] == r[0] and x[6] == r[6] for x in out)) for r in out]


@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])  # in Berlin an hour of that night doesn't exist
def test_funnels_against_brute_force(spark, zone):
    rows = _clicks()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = funnel.count_funnels(spark.createDataFrame(rows, CLICKS)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(map(tuple, got), key=str) == sorted(_brute(rows), key=str)
    assert {r.client_id for r in got} >= {1, 7, 8}


def test_funnels_of_nothing(spark):
    empty = spark.createDataFrame([], CLICKS)
    assert funnel.count_funnels(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None, None, None)], CLICKS)
    assert funnel.count_funnels(nulls).count() == 0


def test_percentiles_by_bins(spark):
    rng = random.Random(1)
    values = {("a", 1): [rng.randrange(1, 1 << 32) for _ in range(501)], ("b", 2): [5] * 40, ("c", 3): [1 << 20, 1, (1 << 20) - 1]}
    rows = [(*k, d) for k, ds in values.items() for d in ds]
    got = funnel._percentiles(spark.createDataFrame(rows, "g string, h int, d long"), ["g", "h"], 90).collect()
    assert {(r.g, r.h): r.value for r in got} == {k: sorted(v)[math.ceil(len(v) * 0.9) - 1] for k, v in values.items()}


VECTORS = "vec_id long, embedding array<float>, label int, v string, cluster string"


def _vectors():
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], 0, "clash", "clash") for i in range(300)]
    rows += [(i, list(rows[0][1]), 0, "", "") for i in (400, 400, 401)]
    rows += [(500, None, 0, "", ""), (501, [], 0, "", ""), (502, [0.5] * 63, 0, "", ""), (503, [0.5] * 65, 0, "", ""), (504, [0.5] * 63 + [None], 0, "", ""),
             (505, [float("nan")] + [0.5] * 63, 0, "", ""), (506, [float("inf")] + [0.5] * 63, 0, "", ""), (None, [0.25] * 64, None, None, None)]
    return rows


def _clusters(rows, k):
    import numpy as np

    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    c = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(5):
        at = [nearest(v)[1] for _, v in kept]
        c = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [v for (_, v), a in zip(kept, at, strict=True) if a == j]) else x for j, x in enumerate(c)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    return [(i, j, d, sum(x[2] for x in found if x[1] == j), sum(x[2] for x in found), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found]


@pytest.mark.parametrize("k", [1, 9, 40])
def test_clusters_against_brute_force(spark, k):
    got = centroids.clustered(spark.createDataFrame(_vectors(), VECTORS), k=k).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_clusters(_vectors(), k), key=str)


def test_clusters_of_few_and_none(spark):
    few = spark.createDataFrame(_vectors()[:3], VECTORS)
    assert sorted((r.vec_id, r.distance) for r in centroids.clustered(few).collect()) == [(0, 0), (1, 0), (2, 0)]
    assert centroids.clustered(few.limit(0)).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        centroids.clustered(spark.createDataFrame([(1, [3e30] * 64, 0, "", "")], VECTORS)).count()


def test_search_takes_the_smaller_of_equal_centroids():
    import numpy as np

    rng = np.random.default_rng(0)
    v, c = rng.integers(-3, 3, (500, 64)), rng.integers(-3, 3, (12, 64))
    c[7] = c[2]
    at, far = centroids.search(v, c, np.arange(64)[::-1])
    whole = ((v[:, None] - c[None]) ** 2).sum(axis=2)
    assert (at == whole.argmin(axis=1)).all() and (far == whole.min(axis=1)).all() and 7 not in at


def _site(i, body, extra=""):
    return f"""<!doctype html><html><head><title>Title {i}</title><style>p{{}}</style><script>var a = "</p><p>no";</script></head><body>
<div class="top"><div>Our Site<p>Best   site since 1999</div><ul><li><a href="/{i}">Home</a><li>About</ul></div>
<div id=content>{body}<div class="box"><p>Get our letter every week</p></div></div>{extra}<div>Imprint of the site &copy; 2024</div></body></html>"""


def _pages():
    rows = [(i, f"https://Site.example.org:80/{i}?a#b", _site(i, f"<h1>Title {i}</h1><p>First &amp; <b>bold</b>\n\t text&nbsp;{i}<br>goes on<p>Second {i}")) for i in range(8)]
    rows += [(100 + i, f"http://copies.example.org/{i}", _site("copy", "<h1>Title copy</h1><p>Same text in all copies</p>")) for i in range(8)]
    rows += [(200, None, "<article><h1>A</h1><header>By me</header><p>One<nav>menu</nav></p><div class='share'>x</div><section id='comments'><article>reader says</article></section></article><footer>f</footer>"),
             (201, "x", None), (202, "", ""), (203, "http://a.example/", "no <markup & 3 < 4"), (204, "http://a.example/", "<body class='has-sidebar'><main><p>kept</p><form>f<p>g</form></main><aside>s</aside>"),
             (205, "http://a.example/", "<p><b>open<br><p>next<div><span class=ad>gone<span>too</span> all</span>stays</div><!-- <p>c --><table><tr><td>1<td>2</table>&#x41;&lt;p&gt;"),
             (206, "http://a.example/", "<article class='widget'><p>only one</article>"), (206, "http://a.example/", "<article class='widget'><p>only one</article>"),
             (207, "http://a.example/", "<script>never ends <p>x"), (208, "http://a.example/", "<p>a</b></i></div>b</p>c</p>d")]
    return rows


WANT = {200: "A\nBy me\nOne", 201: "", 202: "", 203: "no", 204: "kept", 205: "open\nnext\nstays\n1\n2\nA<p>", 206: "only one", 207: "", 208: "ab\nc\nd"}


@pytest.mark.parametrize("most", [1000, 0])  # broadcast, and met by host
def test_articles(spark, most):
    rows = [(*r, "clash", 1) for r in _pages()]
    got = html_article.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string, templates int"), most=most).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    for i in range(8):  # what the host repeats on all titles has gone
        assert texts[i] == f"Title {i}\nFirst & bold text {i} goes on\nSecond {i}"
    # copies of one page alone don't tell a template
    assert "Same text in all copies" in texts[100] and "Our Site" in texts[100]
    assert {i: texts[i] for i in WANT} == WANT
    assert html_article.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_article.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_a_very_long_page(spark):
    long = "<article>" + "<div><p>word &amp; word</p>" * 60_000 + "</article>"
    deep = "<div>" * 20_000 + "deep" + "</div>" * 20_000
    got = html_article.extract(spark.createDataFrame([(1, "u", long), (2, "u", deep)], "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {1: "\n".join(["word & word"] * 60_000), 2: "deep"}
