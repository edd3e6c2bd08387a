import html
import re
from html.parser import HTMLParser

from panelwise.llm import mainpath
from panelwise.llm.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """Text blocks of the article element, with the library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [[]]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag in ("p", "h1", "article"):
            self.blocks.append([])
        elif tag == "br":
            self.blocks[-1].append(" ")

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside = False
        if tag in ("p", "h1", "article"):
            self.blocks.append([])

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1].append(data)

    def text(self):
        return "\n".join(x for x in (" ".join("".join(b).split()) for b in self.blocks) if x)


def test_query_equals_the_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op7_mainpath"](spark, FOLDER).collect()
    assert len(rows) == len(pages)
    for r in rows:
        a = Article()
        a.feed(pages[r.page_id].html)
        a.close()
        assert r.text == a.text() and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><div class="cookie-banner"><p>We use cookies, accept them all please, it is long.</p></div>
<div id="wrap"><div class="post-body-{n}"><h2>Title {n}</h2><p>First &amp; foremost&nbsp;text <b>bold<br>next</b> words of page {n}.<p>Second block<script>var a="</p>";</script> goes on &eacute;.
<ul><li>one<li>two</ul><form><p>Your name</p></form><blockquote>Quoted <a href="x">link</a></blockquote></div>
<div class="rightSidebar"><p>{long}</p></div><div id="comments"><p>{long}</p></div><!-- <p>hidden</p> --></div><footer>&copy; all</footer>"""


def page(n, long="Reader says many things here. " * 20):
    return PAGE.format(n=n, long=long)


def expected(n):
    return f"Title {n}\nFirst & foremost text bold next words of page {n}.\nSecond block goes on é.\none\ntwo\nQuoted link"


def test_other_templates_and_odd_rows(spark):
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(6)]
    rows += [(20, "http://h.example/x", None), (21, None, ""), (22, None, "plain &lt;text&gt;\n here"), (23, "http://h.example/odd", "<div class=other><p>Own page of another kind</p></div>"), (0, "http://h.example/0", page(0))]
    rows += [(30, "http://h.example/long", page(7).replace("Second block", "Second block " + "w " * 100000))]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id bigint, url string, html string, text string, host int")
    got = [(r.page_id, r.text) for r in mainpath.extract(df).collect()]
    by = dict(got)
    assert len(got) == len(rows)
    assert all(by[i] == expected(i) for i in range(6))
    assert by[20] == by[21] == "" and by[22] == "plain <text> here" and by[23] == "Own page of another kind"
    assert by[30].count("w ") >= 99999
    assert mainpath.extract(df.where("false")).count() == 0


def test_consensus_beats_a_page_with_more_text_elsewhere(spark):
    odd = page(9).replace('<div class="rightSidebar">', '<div class="zone">')
    assert "Reader" in mainpath.text_of(mainpath.parse(odd), None)
    df = spark.createDataFrame([(i, "http://a/1", page(i)) for i in range(5)] + [(9, "http://a/2", odd)], "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in mainpath.extract(df).collect()}[9] == expected(9)


def test_random_markup_never_fails():
    import random

    rng = random.Random(0)
    parts = ["<p>", "</p>", "<div class='a'>", "</div>", "<", ">", "&amp", "&#x41;", "text", "<!--", "-->", "<script>", "</script>", '<a href="', "'", "<td>", "<li>", "</ul>", "<br/>", "<article>", "\x00"]
    for _ in range(2000):
        source = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        mainpath.text_of(mainpath.parse(source), None)
    assert html.unescape("&amp") == "&" and re


def test_names_of_content_are_not_noise():
    inner = ("<h2 id=related-work>Related work</h2><p class=notice>First long paragraph of text.</p><section id=discussion><h2 id=search-algorithms>Search</h2>"
             "<p id=share>Second long paragraph.</p></section><div data-role=form><p>Third part.</p></div>")
    want = ["Related work", "First long paragraph of text.", "Search", "Second long paragraph.", "Third part."]
    page = f"<body><article>{inner}</article><div class='site-footer'><p>Foot</p></div><div class=comments><p>Said</p></div></body>"
    assert mainpath.text_of(mainpath.parse(page), None).split("\n") == want
    for names in ("content no-sidebar", "post has-comments", "sidebar"):
        parsed = mainpath.parse(f"<body><div class='{names}'>{inner}</div><div class=ad><p>Buy</p></div></body>")
        assert [x for _, x in parsed.blocks] == want


def test_a_fragment_does_not_win_over_its_article():
    post = f"<div class=post><h1>Title</h1><p>{'i' * 100}</p><blockquote><p>{'q' * 300}</p></blockquote><p>{'o' * 40}</p></div>"
    want = ["Title", "i" * 100, "q" * 300, "o" * 40]
    assert mainpath.text_of(mainpath.parse(f"<body>{post}<div><a href=x>{'l' * 50}</a></div></body>"), None).split("\n") == want
    wrapped = f"<body><article><div class=wrap><section class=a><p>{'a' * 700}</p></section><section class=b><p>{'b' * 300}</p></section></div></article></body>"
    assert mainpath.text_of(mainpath.parse(wrapped), None).split("\n") == ["a" * 700, "b" * 300]
    deep = f"<body><div class=post><p>{'i' * 100}</p><div class=wrap><div class=text><p>{'t' * 500}</p></div></div></div></body>"
    assert mainpath.text_of(mainpath.parse(deep), None).split("\n") == ["i" * 100, "t" * 500]
    headed = f"<body><main><h1>Title</h1><article><p>{'t' * 500}</p></article><div><p>{'s' * 40}</p></div></main></body>"
    assert "t" * 500 in mainpath.text_of(mainpath.parse(headed), None)


def body(inner):
    return mainpath.text_of(mainpath.parse(f"<body><article>{inner}</article><footer>end</footer></body>"), None)


def test_stray_quotes_lose_no_text():
    for tag in ("<img alt=Bob's>", '<a href="x"" title=y>', "<b title='it's'>", '<i data-x=a"b>', "<u '>", '<s ">', "<q cite = 'x' \" y>", '<a href=/x?a="1&b=2>', "<br/'>"):
        assert body(f"<p>before {tag}after</p><p>last</p>").split() == ["before", "after", "last"], tag
    assert body('<p>one <a title="2 > 1" href=x>two</a> <b title=\'<p>\'>three</b></p>') == "one two three"
    assert mainpath.attributes_of(''' class="a b" CLASS=c id=x data-id=y title="class=ad" role = 'main' checked''') == {
        "class": "a b", "id": "x", "data-id": "y", "title": "class=ad", "role": "main", "checked": ""}


def test_formulas_stay_in_their_sentence():
    assert body("<p>If <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p>") == "If x=1 holds."


def test_very_deep_pages_end_with_all_their_text():
    n = 100_000
    for opened, closed in (('<div class="sidebar">', "</div>"), ("<div>", "</div>"), ("<section class=x1>", ""), ("<ul><li>", ""), ("<blockquote>", "</p>" * 2)):
        page = mainpath.parse("<p>first</p>" + opened * n + "<p>" + "deep words " * 50 + "</p>" + closed * n + "<p>last</p>")
        text = mainpath.text_of(page, None)
        assert "deep words deep" in text
    # Names that say sidebar are kept where they hold the page's text, at any depth.
    nested = "<div class=sidebar>" * 50 + f"<p>{'t' * 500}</p><div class=comments><p>no</p></div>" + "</div>" * 50
    assert mainpath.text_of(mainpath.parse(nested), None) == "t" * 500
