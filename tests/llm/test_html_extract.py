import random
import time
from html.parser import HTMLParser

import pytest

from tidemark.llm import html_extract as op

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{margin:0}</style><script>var t="</p><article>";</script></head><body>
<nav><ul><li><a href="/a">A</a></li><li>B</ul></nav><!-- ad 0 <article> --><div class="ad">Buy</div><header>Site</header>
<article><header><h1>He%s  said &lt;hi&gt; &amp;amp; &copy;</h1></header><p><b>One <i>two</i>three.<br>four<p>Five &#233; &am<ul><li>x<li>y</ul>
<script>no()</script><div class="comments"><p>first!</p></div><form><p>mail</p></form><aside>see</aside></article>
<div class="cookie-notice">We use</div><footer>&copy; me</footer></body></html>"""


def test_article():
    assert op.main_text(op.parse(PAGE % "")) == "He said <hi> &amp; ©\nOne twothree. four\nFive é &am\nx\ny"


def test_odd_html():
    for page in ("", "<", "< p", "<p", "<p class='x", "a<b", "</p></p>text", "<!--", "<script>x", "<table><td>1<td>2<tr><td>3", "\x00<p>é", "<div " * 500 + ">", "<p><div>" * 3000 + "deep"):
        op.skeleton(root := op.parse(page))
        op.main_text(root)
    assert op.main_text(op.parse("a<br>b <p>c</p>d")) == "a b\nc\nd"
    assert op.main_text(op.parse("x < y && z")) == "x < y && z"


def test_simple_tree_matching_aligns_optional_nodes():
    a = "0 #root\n1 div\n2 h1\n2 p\n1 footer"
    b = "0 #root\n1 nav\n1 div\n2 p\n1 footer"
    assert op.align(a, b) == {0: 0, 1: 2, 3: 3, 4: 4}


def brute_align(a, b):
    """The size of the largest matching that keeps order and parents, by plain recursion over nested lists."""
    if a[0] != b[0]:
        return 0
    m = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1], 1):
        for j, y in enumerate(b[1], 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_align(x, y))
    return 1 + m[-1][-1]


def lines(tree, depth=0):
    return "\n".join([f"{depth} {tree[0]}", *(lines(t, depth + 1) for t in tree[1])])


def test_alignment_is_the_largest_by_brute_force():
    rnd = random.Random(3)

    def tree(depth):
        labels = rnd.sample("abcdef", rnd.randint(0, 5)) if depth < 4 else []
        return ["r" if depth == 0 else None, [[x, tree(depth + 1)[1]] for x in labels]]

    for _ in range(60):
        a, b = tree(0), tree(0)
        found = op.align(lines(a), lines(b))
        assert len(found) == brute_align(a, b) == len(set(found.values()))


def test_wide_and_deep_pages_align_in_no_time():
    wide = "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}><p>{i}</p></div>" for i in range(5000))
    began = time.perf_counter()
    one, two = op.skeleton(op.parse(wide)), op.skeleton(op.parse("<p>x</p>" + wide[2000:]))
    assert len(op.align(one.lines, two.lines)) > 9000
    deep = op.skeleton(op.parse("<div>" * 5000 + "<section>x</section>" + "</div>" * 5000)).lines
    assert len(op.align(deep, deep.replace("section", "em"))) == 5001
    assert time.perf_counter() - began < 20


def test_template_is_constant_across_pages_of_a_host(spark):
    bodies = [f"<body><div><span>Our shop</span></div><div id=c><p>Text number {i} is new</p></div><section>Call us</section></body>" for i in range(5)]
    rows = [(i, f"http://h.example/{i}", b) for i, b in enumerate(bodies)] + [(9, "http://other.example/", bodies[0])]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == [f"Text number {i} is new" for i in range(5)]
    assert got[9] == "Our shop\nText number 0 is new\nCall us"


def test_repeated_articles_stay(spark):
    rows = [(i, "http://h.example/x", PAGE % "") for i in range(6)] + [(7, None, PAGE % 1), (8, "::bad", None), (8, "::bad", ""), (None, "http://h.example/y", PAGE % 2)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = op.extract(df).collect()
    assert len(got) == len(rows)
    assert sum(r.text.startswith("He") and r.text.endswith("x\ny") for r in got) == 8
    assert sum(r.text == "" for r in got) == 2


class Article(HTMLParser):
    """The blocks of the article by the standard library's parser, for pages whose article is one element."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "h2", "div", "ul", "li", "br"):
            self.blocks.append("") if tag != "br" else self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "div", "ul", "li", "article"):
            self.blocks.append("")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in op.extract(pages).collect()}
    for r in pages.collect():
        expected = Article()
        expected.feed(r.html)
        expected.close()
        assert got[r.page_id] == "\n".join(t for t in (" ".join(x.split()) for x in expected.blocks) if t) != ""


def site(k, more="", note="Read more on our site"):
    """A page whose only article elements are teasers; the story is in a div, with a constant line inside."""
    return f"""<html><body><div class="top">Daily <b>News</b> of the town</div><div class="story-{k}"><h1>Story {k}</h1><p>{"What happened in case " + str(k) + ". " * 3}{"x" * k * 9}</p>
<p>{note}</p><p>The end of {k} &amp; more</p>{more}</div><div class="teasers"><article>Teaser {k}</article></div><div class="legal">Imprint</div></body></html>"""


def test_the_template_decides_what_an_element_holds(spark):
    rows = [(k, f"http://n.example/{k}", site(k)) for k in range(8)]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, page in rows:
        want = [f"Story {k}", " ".join(("What happened in case " + str(k) + ". " * 3 + "x" * k * 9).split()), f"The end of {k} & more"]
        assert got[k] == "\n".join(want)
        assert op.main_text(op.parse(page)) == f"Teaser {k}"  # without a template the page says nothing better


def test_names_that_only_contain_a_hint_stay():
    page = '<article><p>A</p><div class="related-work">B</div><div class="side">C</div><p class="notice-board">D</p><div class="ad-hoc">E</div><math><mi>x</mi></math><noscript>F</noscript><object>G</object><div class="comments">no</div></article>'
    assert op.main_text(op.parse(page)) == "A\nB\nC\nD\nE\nxF\nG"


def test_every_layout_of_a_host_has_its_template(spark):
    rows = [(k, "http://h.example/x", f"<body><section>Bar</section><div><p>One {k} of many {'y' * k}</p><p>Call us</p></div></body>") for k in range(5)]
    rows += [(10 + k, "http://h.example/y", f"<body><main><p>Two {k} of many {'z' * k}</p><p>Write us</p></main><div class=x>Foot</div></body>") for k in range(4)]
    got = {r.page_id: r.text for r in op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"One {k} of many {'y' * k}".strip() for k in range(5)} | {10 + k: f"Two {k} of many {'z' * k}".strip() for k in range(4)}


def test_near_copies_of_an_article_keep_what_they_share(spark):
    shared = "<p>" + "This long paragraph stands in all near copies of the article. " * 4 + "</p>"
    rows = [(k, f"http://c.example/{k}", f"<body><div><h1>Same title</h1>{shared}<p>Only {k}</p></div><section>{k}</section></body>") for k in range(6)]
    got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Same title\nThis long paragraph" in r.text and f"Only {r.page_id}" in r.text for r in got)


@pytest.mark.parametrize("schema", ["page_id long, url string, html string"])
def test_empty(spark, schema):
    assert op.extract(spark.createDataFrame([], schema)).count() == 0


def test_copies_of_one_page_are_no_template(spark):
    rows = [(10 * h + i, f"http://h{h}.example/{i}", f"<body><div><p>Text of page {i // 9}</p></div></body>") for h in range(5) for i in range(10)]
    got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(k, f"Text of page {k % 10 // 9}") for k, _, _ in rows]


def test_deep_boilerplate_is_template(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><p>New {i}</p>" + "<div>" * 1500 + "Call us" + "</div>" * 1500 + "</body>") for i in range(5)]
    got = op.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == [f"New {i}" for i in range(5)]
