import random
import time
from html.parser import HTMLParser

from docloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><article><h1>Head &amp; line</h1><p><b>One</b>,
 two&nbsp;three<br>four<p>Five &lt;six&gt;<script>var a="</p>";</script><form><p>Name<input></form><div class="ad">Buy</div>
<section id="comments"><p>First!</p></section></article><aside><p>Side</p></aside><footer>(c)</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "Head & line\n\nOne, two three four\n\nFive <six>"


def test_odd_markup():
    for page in (None, "", "<", "<<<p", "<p", "</div></p>", "<!--", "<script>", "<a href='>"):
        html_text.main_text(page)
    assert html_text.main_text("plain  text") == "plain text"
    assert html_text.main_text("<p>a<p>b<ul><li>c<li>d</ul>") == "a\n\nb\n\nc\n\nd"
    assert html_text.main_text('<div class="page has-sidebar no-ads"><p>kept</p><div class="sidebar">x</div></div>') == "kept"
    long = "<p>" + "word " * 200_000 + "</p>"
    assert len(html_text.main_text(long)) == 5 * 200_000 - 1


def _page(k):
    return f'<body><div class="top"><p>Daily News</p></div><div class="x"><h2>Story {k}</h2><p>{"text %d " % k * 20}</p><p>more {k}</p></div><div class="low"><p>Imprint</p></div></body>'


def test_wrapper_finds_the_region_without_article(spark):
    rows = [(k, f"http://h.example/{k}", _page(k)) for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    assert got == {k: f"Story {k}\n\n{('text %d ' % k * 20).strip()}\n\nmore {k}" for k in range(12)}


def wrapper_of(pages):
    wrapper: dict = {}
    for page in pages:
        html_text.align(wrapper, html_text.read_page(page))
    return wrapper


def constants_of(pages):
    return html_text.agreed(wrapper_of(pages))


def test_alignment_is_union_free_and_without_order(spark):
    pages = [_page(1), _page(2), _page(3).replace("<h2>", "<h3>sub</h3><h2>"), _page(4).replace("Imprint", "Imprint, new")]
    whole = wrapper_of(pages)
    for seed in range(6):
        random.Random(seed).shuffle(pages)
        assert wrapper_of(pages) == whole
    rows = [(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = html_text.infer_wrappers(docs.selectExpr("'h' AS host", "html")).collect()
    assert html_text.expression(found) == "#<body>#<div.low>#<p>#<div.top>#<p>=#<div.x>#<h2>#(<h3>=#)?(<p>#)+"
    assert {r["node"]: (r["pages"], sorted(r["constants"])) for r in found} == {html_text._signed(n): (w[2], sorted(html_text._signed(m) for m, (k, _) in w[5].items() if k == w[2])) for n, w in whole.items()}


def test_a_text_that_few_pages_lack_is_an_optional_constant(spark):
    """A notice on 50 of 51 pages goes, on those pages too whose task saw none without it; a text on 40 of 51 stays, as do constants of fewer than three texts."""
    notice, often = "<p>Read our new terms</p>", "<p>Half a page</p>"
    rows = [(k, f"http://h.example/{k}", _page(k).replace("<h2>", (notice if k else "") + (often if k < 40 else "") + "<h2>")) for k in range(51)]
    rows += [(100 + k, "http://twice.example/", _page(k % 2)) for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    assert all("terms" not in t and "Daily" not in t and "Imprint" not in t for k, t in got.items() if k < 100)
    assert all(("Half" in got[k]) == (k < 40) for k in range(51)) and all(f"Story {k}" in got[k] for k in range(51))
    assert all("Daily" in t and "Imprint" in t for k, t in got.items() if k >= 100)
    wrappers = html_text.infer_wrappers(pages.where("page_id < 100").selectExpr("'h' AS host", "html"), 3).collect()
    assert "(=)?" in html_text.expression(wrappers) and sum(len(r["optional_constants"]) for r in wrappers) == 1


def test_class_words_inside_an_article_are_judged_by_the_wrapper():
    page = '<article><div class="share-price-table"><p>Prices rose %d</p></div><div class="notice-board"><p>%s</p></div><p>End %d</p></article>'
    assert html_text.main_text(page % (1, "Read on", 1)) == "Prices rose 1\n\nRead on\n\nEnd 1"
    body = "a long story about %d " * 30
    pages = [page % (k, "Read on", k) + f"<main><p>{body % ((k,) * 30)}</p></main>" for k in range(9)]
    got = html_text.main_text(pages[4], constants_of(pages))
    assert got == f"Prices rose 4\n\nEnd 4\n\n{(body % ((4,) * 30)).strip()}"
    for name, text in {"ad": "", "post-comments": "", "share-buttons": "", "page-header": "", "post-header": "x", "address": "x", "ad-free": "x", "download": "x", "notice special": "x"}.items():
        assert html_text.main_text(f'<div><p>y</p><div class="{name}">x</div></div>') == ("y\n\n" + text).strip(), name


def test_copies_of_one_article_keep_their_text():
    same = "".join(f"<p>paragraph {k} of the same story</p>" for k in range(9))
    pages = [f"<article><h1>Title {k}</h1>{same}</article>" for k in range(7)]
    assert html_text.main_text(pages[0], constants_of(pages)) == html_text.main_text(pages[0])
    assert html_text.main_text(pages[0], constants_of([pages[0]] * 7)) == html_text.main_text(pages[0])


def test_wide_and_deep_pages_are_whole():
    lead, rest = "<p>" + "lead " * 100 + "</p>", "".join(f"<div class='s{k}'>side {k}</div>" for k in range(70))
    pages = [f"<body><div class='a'>{lead}</div>{rest}<div class='real'><p>{f'body {k} ' * 2000}</p></div></body>" for k in range(5)]
    for known in (frozenset(), constants_of(pages)):
        assert f"{'body 3 ' * 2000}".strip() in html_text.main_text(pages[3], known)
    deep = "<div>" * 3000 + "<p>bottom %d</p>" + "</div>tail" * 3000
    pages = [deep % k for k in range(4)]
    assert html_text.main_text(pages[0]).startswith("bottom 0\n\ntail")
    assert html_text.main_text(pages[0], constants_of(pages)) == "bottom 0"
    rounds = "".join(f"<h3>h {k}</h3><p>p {k}</p><ul><li>u {k}</ul>" for k in range(100))
    assert html_text.main_text(f"<div>{rounds}</div><div>short</div>").count("\n\n") == 300


class Plain(HTMLParser):
    """The text blocks inside ``article``, read by the standard library's parser: a brute-force version for the given pages."""

    def __init__(self):
        super().__init__()
        self.depth, self.blocks, self.skip = 0, [""], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style", "form", "aside", "nav", "footer") or ("class", "ad") in attrs
        if tag in html_text._BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= self.skip > 0 and tag in ("script", "style", "form", "aside", "nav", "footer", "div")
        if tag in html_text._BLOCKS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1] += data


def test_given_pages_against_brute_force(spark, sf):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.op3_html_text(spark, sf).collect()}
    assert got.keys() == rows.keys()
    for i, html in rows.items():
        plain = Plain()
        plain.feed(html or "")
        plain.close()
        want = "\n\n".join(" ".join(b.split()) for b in plain.blocks if b.strip())
        assert got[i] == (want, len(want)), i


def test_rows_and_nulls(spark):
    rows = [(1, None, None, 5), (2, "http://a/", "", 5), (2, "http://a/", "", 5), (None, "http://a/", "<p>x</p>", 5), (3, "no url", PAGE, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted([(r["page_id"], r["text"][:6], r["n_chars"]) for r in html_text.extract_text(pages).collect()], key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (2, "", 0), (3, "Head &", 44), (None, "x", 1)], key=str)
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_what_is_not_closed_loses_no_text():
    for page, want in {
        "<head><meta><title>T</title><article><p>All the text</p></article>": "All the text",
        '<p>One</p><svg class="i"/><p>Two</p><svg><path/></svg><p>Three</p>': "One\n\nTwo\n\nThree",
        "<p>One</p><math/><p>Two</p>": "One\n\nTwo",
        "<p>One</p><svg><path><p>Two</p></svg><p>Three</p>": "One\n\nTwo\n\nThree",
        "<div><button>Go</div><p>Two</p><button>x</button>": "Go\n\nTwo",
        "<p>One</p><select><p>Two</p>": "One\n\nTwo",
        "<p>a <button>Go</button> b <svg><title>t</title><text>x</text></svg></p>": "a b",
        '<div class="content-sidebar-wrap"><main><p>Text</p></main><p>Side</p></div>': "Text",
        '<div class="page-sidebar"><article><p>Text</p></article></div><p>Low</p>': "Text",
        '<form><article><p>Text</p></article></form>': "Text",
        '<article><p>Text</p></article><div class="sidebar"><article><p>Other</p></article></div>': "Text",
    }.items():
        assert html_text.main_text(page) == want, page


def test_attributes_are_whole_names():
    for page, want in {
        '<article title="The hidden life of bees"><p>All of it</p></article>': "All of it",
        '<article><p aria-hidden="false">All</p><p data-style="display:none">of it</p></article>': "All\n\nof it",
        "<article><p hidden>no</p><p HIDDEN=''>no</p><p style='color:red; display : none'>no</p><p>yes</p></article>": "yes",
        "<div role='main'><p>Text</p></div><p>Low</p>": "Text",
        '<article><p>One <span class="ad">buy <b>now</b></span> two <i style="display:none">x</i>three</p><p>four <span class="ad-free">five</span></p></article>': "One two three\n\nfour five",
        '<article><p>One <span class="ad">buy<p>Two</p></article>': "One\n\nTwo",
        '<div class="newsletter"><p>The only text</p></div>': "The only text",
        '<form><p>The only text</p></form>': "The only text",
        '<article><div class="side"><p>Side A of the record</p></div></article>': "Side A of the record",
        "<p>One</p><noscript><p>Two</p><p>Three</p>": "One\n\nTwo\n\nThree",
        "<p>One</p><iframe><p>Two</p>": "One\n\nTwo",
        "<p>One</p><noscript><p>No</p></noscript><p>Two</p><script>x<p>": "One\n\nTwo",
    }.items():
        assert html_text.main_text(page) == want, page


def test_hostile_pages_are_read_in_linear_time():
    n = 125_000
    pages = ["<object>" * n + "</object>" * n, "<button>" * n + "</button>" * n, "<button>" * n, "<div>" * n + "</p>" * n, "<ul>" + "<div>" * n + "<li></li>" * n, "<h1>" * n + "<p></p>" * n]
    pages += ["<noscript>" * n, "<a" * n, "<!" * n, '<a "' * n + ">", "<svg><path/>" * n + "</svg>" * n, "<svg><div>" * n + "</svg>" * n, "</div><object>" * n, '<p class="x" ' * n, "<!--" * n]
    for page in pages:
        began = time.perf_counter()
        html_text.main_text(page + "<p>end</p>")
        assert time.perf_counter() - began < 20, page[:30]
