import html
import itertools
import re
import time

import numpy as np
import pytest
from checktool import SF_DIR

from crosstide.llm import catalogue, html_extract as H


@pytest.fixture(scope="module")
def field(spark):
    return H.fit(spark.read.parquet(f"{SF_DIR}/pages.parquet"))


def test_viterbi_and_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    f = H.Field()
    f.pair, f.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    names = [[f"f{i}", f"g{i % 2}"] for i in range(7)]
    for n in {x for fs in names for x in fs}:
        f.weights[n] = rng.normal(size=2)
    e = f.emissions(names)
    score = lambda y: f.start[y[0]] + sum(e[i][k] for i, k in enumerate(y)) + sum(f.pair[a, b] for a, b in zip(y, y[1:]))
    every = list(itertools.product((0, 1), repeat=7))
    weight = np.exp([score(y) for y in every])
    assert f.decode(names) == list(max(every, key=score))
    p, pairs = f.marginals(e)
    for i in range(7):
        assert p[i, 1] == pytest.approx(sum(w for w, y in zip(weight, every) if y[i]) / weight.sum())
    assert pairs[0, 1] == pytest.approx(sum(w * sum(a == (0, 1) for a in zip(y, y[1:])) for w, y in zip(weight, every)) / weight.sum())


def test_blocks():
    got = [t for t, _, _ in H.blocks("<p>a &amp;\n b&nbsp;c<br>d <b>e</b>f<p>g<div>h<span>i</span></div>j<script>x</script><!-- no --><ul><li>k<li>l</ul>"
                                     "<style>p{}</style><table><tr><td>m<td>n</table>&#233;&eacute;")]
    assert got == ["a & b c d ef", "g", "hi", "j", "k", "l", "m", "n", "éé"]


@pytest.mark.parametrize("page", [None, "", "<", "<html>", "<p", "&", "<a href=\"/x y", "<!-- a <b> ", "</p></div>", "<article></article>", "<!--", "<script>var a='<p>b</p>'"])
def test_pages_without_text(field, page):
    assert H.extract(field, page) in ("", "<", "&")


LAYOUTS = {
    "plain": ("<body><nav><a href=/>Home</a></nav><article><h1>T</h1><p>One is here.</p><p>Two.</p></article><footer>&copy; x</footer>", "T\nOne is here.\nTwo."),
    "main": ("<header>Site</header><main><h1>T</h1><p>One is here. It goes on.</p></main><aside><p>Side text. More of it.</p></aside>", "T\nOne is here. It goes on."),
    "comments": ("<article><p>One is here. It goes on.</p><p>Two.</p><section id=comments><p>I agree. So it is.</p></section></article>", "One is here. It goes on.\nTwo."),
    "sidebar": ("<div class=wrap><div class=sidebar><ul><li><a href=x>a</a></li></ul></div><div class=content><h1>T</h1><p>One is here. It goes on and on.</p></div></div>",
                "T\nOne is here. It goes on and on."),
    "notice": ("<div class='cookie-notice'>We use cookies. Agree to it.</div><article><p>One &lt; two &amp; three.</p></article>", "One < two & three."),
    "advert": ("<article><p>One is here.</p><div class=ad>Buy this. Now.</div><p>Two is here.</p></article>", "One is here.\nTwo is here."),
    "form": ("<article><p>One is here.</p></article><form><label>Name</label><input><button>Send</button></form>", "One is here."),
    "aside inside": ("<main><p>One.</p><aside><p>Rel.</p></aside><p>Two.</p></main>", "One.\nTwo."),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(field, name):
    page, want = LAYOUTS[name]
    assert H.extract(field, page) == want


def article(page):
    """The article by its own marks; for the given pages only."""
    inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page, re.S)[1].replace("<b>", "").replace("<br>", "\n")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"<p>|</p>|</?h1>", inner)]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    got = catalogue.QUERIES["op8_html_extract"](spark, SF_DIR).collect()
    assert len(got) == len(pages)
    assert all(r.text == article(pages[r.page_id]) and r.n_chars == len(r.text) for r in got)


def test_decodes_without_semantic_tags(field):
    held = [(f"<div class=page><div class=menu><a href=/>Home</a></div><div class=text><h2>T {i}</h2><p>Line one of {i}. It goes on.</p><p>End.</p></div>"
             f"<div class=footer>&copy; {i}</div></div>", f"T {i}\nLine one of {i}. It goes on.\nEnd.") for i in range(20)]
    assert all(H.extract(field, p) == w for p, w in held)


def test_nulls_repeats_empty_table_and_long_page(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    long = "<article>" + "<p>Word one. Word two.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, "x", 1), (None, "u", "<article><p>a b.</p></article>", "x", 1), (1, None, None, "x", 1), (2, "u", long, "x", 1)]
    got = H.report(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 4), (1, 0), (1, 0), (2, 20_000 * 19 + 19_999)]
    assert H.report(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("start", ["<body>", "", "<script>var a = '<p>no</p>'</script><body class=x>", "<noscript><link href=x></noscript>", "<style>p{}</style>\n<body>"])
def test_head_without_its_end_tag(start):
    page = f"<!doctype html><html><head><meta charset=utf-8><title>T &amp; <p>t</title><link href=x>{start}<p>One.<p>Two."
    assert [t for t, _, _ in H.blocks(page)] == ["One.", "Two."]
    assert [t for t, _, _ in H.blocks("<head><title>T</title>One.<p>Two.")] == ["One.", "Two."]
    assert [t for t, _, _ in H.blocks("<head><title>T</title><template><p>x</p></template></head><body>One.")] == ["One."]


def test_features_of_the_path_are_a_set():
    found = H.blocks("<div class='a b'><div class=a><p>x<em class=a>y</em></div>z</div>w")
    named = [[f for f in fs if f.startswith(("in", "tag"))] for fs in H.features(found)]
    assert named == [["in:class=a", "in:class=b", "in=div", "in=p", "tag=p"], ["in:class=a", "in:class=b", "in=div", "tag=div"], ["tag=none"]]
    f = H.Field()
    rng = np.random.default_rng(1)
    for n in {x for fs in H.features(found) for x in fs}:
        f.weights[n] = rng.normal(size=2)
    f.pair, f.start = rng.normal(size=(2, 2)), rng.normal(size=2)
    assert f.labels(found) == f.decode(H.features(found))


@pytest.mark.parametrize("piece", ["<div>x", "<div class=c{i}>x", "<span>", "<span><li>x</li>", "<ul><li>x", "<p><b>x", "<a href=y>x", "<head><b>", "</em>x<em><div>"])
def test_deep_pages_take_time_in_proportion(field, piece):
    def seconds(n):
        page = "".join(piece.replace("{i}", str(i)) for i in range(n // len(piece)))
        start = time.process_time()
        H.extract(field, page)
        return time.process_time() - start
    assert seconds(1_000_000) < 5 * max(1.0, 5 * seconds(200_000))


def stripped(page):
    """The page without attributes, its block tags all alike."""
    page = re.sub(r"<(script|style)\b.*?</\1>", "", page, flags=re.S | re.I)
    return re.sub(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>", lambda m: f"<{m[1]}div>" if m[2].lower() in H.BLOCK else "<a>" if m[2].lower() == "a" and not m[1] else "</a>" if m[2].lower() == "a" else "", page)


def test_text_and_links_carry_weight_without_markup(spark, field):
    right = kept = wanted = 0
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").limit(150).collect():
        want = set(article(r.html).split("\n"))
        got = H.extract(field, stripped(r.html)).split("\n")
        kept, wanted, right = kept + len(got), wanted + len(want), right + sum(x in want for x in got)
    print(f"precision {right / kept:.3f}, recall {right / wanted:.3f}")
    assert right / kept > 0.8 and right / wanted > 0.9
