"""Main text against a slow reading of the test tables' pages, and pages of other make."""

import time
from html.parser import HTMLParser

import pytest

from shellac.llm.htmltext import extract_main_text, main_text


class _Article(HTMLParser):
    """Blocks of the article element, read by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p"):
            self.inside = self.inside or tag == "article"
            self.blocks.append("")
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def _slow(page):
    reader = _Article()
    reader.feed(page)
    if reader.rawdata and not reader.rawdata.startswith("<"):  # a page cut within a reference
        reader.handle_data(reader.rawdata)
    return "\n".join(t for t in (" ".join(b.split()) for b in reader.blocks) if t)


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, _slow(r.html)) for r in pages.collect()}
    got = {r.page_id: (r.url, r.text) for r in extract_main_text(pages).collect()}
    assert got == want and len(got) > 200


PROSE = "<p>Rivers rise in the hills, run through woods, and reach the sea.</p>"
SIDE = "Much, much, more, text, with, many, commas, than, the, article, has, to, score, with, if, it, were, not, marked. " * 5
PAGES = {
    "plain words": ("just  text", "just text"),
    "unmarked divs": (f"<div><div>{PROSE * 3}</div><div><a href=/a>Home</a> <a href=/b>News</a></div></div>", "\n".join([PROSE[3:-4]] * 3)),
    "boilerplate": (
        f'<body><div class="site-header"><a href="/">Site</a></div><ul id="main-menu"><li><a href=a>A</a><li><a href=b>B</a></ul>'
        f'<div class="content"><h1>Rivers</h1>{PROSE}<div class="ad">{SIDE}</div>{PROSE}</div><div id="sidebar"><p>{SIDE}</p></div>'
        f'<section id="comments"><p>{SIDE}</p></section><div class="cookie-notice">We use cookies, {SIDE}</div><form>Name <input></form><footer>c</footer>',
        f"Rivers\n{PROSE[3:-4]}\n{PROSE[3:-4]}",
    ),
    "no body tags, list, table": (
        "<article><p>One &lt;b&gt; &amp; two&nbsp; three<p>four<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table></article>",
        "One <b> & two three\nfour\na\nb\nc\nd\ne",
    ),
    "raw elements": ('<article>a<script>"</article><p>x"</script><style>p</style>b<!-- <p>c --></article><p>no', "ab"),
    "quotes": ("<article><p><a title=\"a>b\" href='x'>link</a> &quot;q&quot; 1 < 2</p></article>", 'link "q" 1 < 2'),
    "cut in a tag": ("<article><p>abc</p><p>def <a hre", "abc\ndef"),
    "cut in a reference": ("<article><p>abc &am", "abc &am"),
    "cut in a script": ("<article><p>abc<script>var x", "abc"),
    "hidden": ('<main><p hidden>no</p><p style="display: none">no</p><p aria-hidden=true>no</p><p>yes</p></main>', "yes"),
    "spans and buttons": ('<main><p>see <span class="ad">AD</span>this <button>Click</button> now</p></main>', "see this now"),
    "states say nothing": (f'<div class="post has-sidebar no-comments">{PROSE}</div>', PROSE[3:-4]),
    "nested comments": (
        f'<article class="post"><header><h1>T</h1></header>{PROSE}<section class="comments"><article class="comment"><p>{SIDE}</p></article></section></article>',
        f"T\n{PROSE[3:-4]}",
    ),
    "sections": (f'<div id="wrap"><div class="part">{PROSE * 5}</div><div class="part"><h2>Short</h2><p>tiny</p></div></div>', "\n".join([PROSE[3:-4]] * 5 + ["Short", "tiny"])),
    "nothing else": ('<div class="sidebar"><p>only this</p></div>', "only this"),
    "nothing": ("<nav><a href=x>a</a></nav><!-- c --><script>x</script>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    assert main_text(page) == want


@pytest.mark.parametrize("piece", ["<div>x", "<p>", '<a href="', "</section>", "<b ", "<ul><li>x", "<table><tr><td>", "<!--", "&amp", "<span class=ad>", "<script>"])
def test_long_broken_pages(piece):
    start = time.time()
    main_text(piece * 20_000)
    assert time.time() - start < 10


def test_edges(spark):
    columns = "page_id long, url string, html string, text string, id int, n_chars int"
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, "u", "<p>é\U0001f600 &#233;</p>"), (3, None, "<article><p>" + "word " * 200_000 + "</p></article>")]
    frame = spark.createDataFrame([(*r, "t", 1, 2) for r in rows], columns)
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in extract_main_text(frame).collect()]
    assert sorted(got, key=str) == sorted([(None, None, "", 0), (1, "u", "", 0), (1, "u", "", 0), (2, "u", "é\U0001f600 é", 4), (3, None, ("word " * 200_000).strip(), 999_999)], key=str)
    assert extract_main_text(frame.limit(0)).count() == 0
