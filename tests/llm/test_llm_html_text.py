"""Main text of pages: templates by hand, the pages table against a plain parser, hosts that vote."""

import time
from html.parser import HTMLParser

import pytest

from tallyloom.llm import html_text, queries

SCHEMA = "page_id long, url string, html string, host string, text string, `_won` string"


def table(spark, rows):
    return spark.createDataFrame([(*r, None if n % 2 else "clash", "x", None) for n, r in enumerate(rows)], SCHEMA)


def extracted(df):
    rows = df.collect()
    assert df.columns == ["page_id", "url", "text", "n_chars"]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    return sorted(((r["page_id"] is not None, r["page_id"], r["text"]) for r in rows), key=str)


def alone(source):
    return html_text.Page(source).main_text([])


TEMPLATES = [
    # semantic elements, comments that are articles, a header of the article
    ("""<!doctype html><html><head><title>T</title></head><body class="single sidebar-right"><header class="site-header"><h1>Site</h1></header>
     <nav><ul><li><a href=a>A</a></ul></nav><main><article class="post"><header class="entry-header"><h1>A title</h1><p>by someone</p></header>
     <p>First   paragraph &amp; more.</p><aside>beside</aside><div class="ad-slot">Buy</div><blockquote>Said &ldquo;so&rdquo;</blockquote>
     <section class="comments"><article class="comment"><p>A reader wrote a very very very very long reply to this.</p></article></section></article></main>
     <footer><p>&copy; all</p></footer></body></html>""", "A title\nFirst paragraph & more.\nSaid “so”"),
    # nothing but divisions and their names
    ("""<body><div id="topMenu"><a href=1>One</a> <a href=2>Two</a></div><div class="cookie-notice">We use cookies, many of them, for everything we do here</div>
     <div class="wrap has-sidebar"><div class="story-17"><h2>Heading</h2><div>Text one is here.</div><div>Text two<br>goes on.</div></div>
     <div class="sidebar"><p>Side text that is longer than the article, by a good deal, and by more and more.</p></div></div>
     <div class="newsletter"><form><p>Sign up</p></form></div><div id="comments-list"><p>What a long comment to make here, and on, and on, and on</p></div></body>""",
     "Heading\nText one is here.\nText two goes on."),
    # unclosed elements, a menu without a name, raw text
    ("""<ul><li><a href=1>Home</a><li><a href=2>News</a><li><a href=3>Mail</a></ul><h1>Top</h1><p><b>Bold start<p>next <i>one<p>and<ul><li>item one<li>item
     two</ul><script>if (a < b) document.write("<p>not this</p>")</script><style>p { }</style><noscript>no</noscript><textarea><p>no</textarea>""",
     "Top\nBold start\nnext one\nand\nitem one\nitem two"),
    ("<table><tr><td>left cell text<td>right cell text<tr><td>below</table>", "left cell text\nright cell text\nbelow"),
    ("no markup &lt;at all&gt; &#169;", "no markup <at all> ©"),
    ("<p>kept</p><p hidden>no</p><p style='display: none'>no</p><div aria-hidden='true'>no</div><div role=\"navigation\">no</div><!-- <p>no</p> -->", "kept"),
    ("<pre>a\n   b\tc</pre><p>x&nbsp;y</p>", "a b c\nx y"),
    ("<article><h1>Only a title</h1></article>", "Only a title"),
    ("<p>before <!-- never closed <p>after", "before"), ("", ""), ("   \n ", ""), ("<nav>menu</nav>", ""), ("<", "<"), ("</p></div>", ""),
    ("<script>never closed <p>x</p>", ""),
]


@pytest.mark.parametrize("source, text", TEMPLATES)
def test_main_text_of_templates(source, text):
    assert alone(source) == text


def test_hostile_pages_take_linear_time():
    started = time.time()
    for source in ("<div>" * 30_000 + "x" + "</b>" * 1000, "<p><b>x" * 20_000, "<a " * 100_000, "<b>" * 20_000 + "<p>q</p>" * 20_000,
                   "\"<x '" * 20_000, "<!--" * 50_000, "<a b='" * 20_000, "&" * 200_000):
        alone(source)
    assert time.time() - started < 60


def blurb(host, n, article, beside):
    return f"http://{host}/{n}", (f'<body><div class="top"><p>{beside}</p></div><div class="text t{n}"><h1>Page {n}</h1><p>{article}</p></div></body>')


def test_a_host_outvotes_its_odd_pages(spark):
    """Where the text is short the blurb scores best, but the host knows its container; other hosts keep their own."""
    long_text, short = "Words of an article that goes on for quite a while. " * 4, "Brief."
    rows = [(n, *blurb("A.example", n, short if n in (3, 7) else long_text, "A blurb that is of middling length.")) for n in range(12)]
    rows += [(20, *blurb("b.example", 20, short, "A blurb that is of middling length."))]
    rows += [(21, None, rows[0][2]), (22, "not an address", rows[1][2]), (23, rows[0][1], None), (24, rows[0][1], ""), (None, *rows[0][1:]), (0, *rows[0][1:])]
    found = extracted(html_text.main_texts(table(spark, rows)))
    expected = {n: f"Page {n}\n{(short if n in (3, 7) else long_text).strip()}" for n in range(12)}
    expected |= {20: "A blurb that is of middling length.", 21: expected[0], 22: expected[1], 23: "", 24: ""}
    assert sorted(found, key=str) == sorted([(False, None, expected[0]), (True, 0, expected[0]), *((True, n, t) for n, t in expected.items())], key=str)
    won = html_text.consensus(table(spark, rows)).filter("host = 'a.example'").collect()
    assert [(r["selector"], r["votes"]) for r in won] == [("body/div.t#.text", 12)]


def test_no_consensus_without_a_leader(spark):
    """A host whose pages all differ has no winner, whatever it is made of."""
    rows = [(n, "http://odd.example/", f"<div class='{chr(97 + n % 26)}{chr(97 + n // 26)}'><p>text number {n} of some length</p></div>") for n in range(40)]
    assert html_text.consensus(table(spark, rows)).collect() == []
    assert extracted(html_text.main_texts(table(spark, rows))) == sorted(((True, n, f"text number {n} of some length") for n in range(40)), key=str)


def test_pages_of_nothing(spark):
    assert html_text.main_texts(table(spark, [])).collect() == []


class Plain(HTMLParser):
    """Text in the article element, cut at paragraphs and headings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        self.blocks += [""] * (tag in ("p", "h1"))

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        self.blocks += [""] * (tag in ("p", "h1"))

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_query_equals_a_plain_parser(spark, sf_dir):
    pages = queries.table(spark, sf_dir, "pages").collect()
    expected = []
    for r in pages:
        parser = Plain()
        parser.feed(r["html"] or "")
        parser.close()
        expected.append((True, r["page_id"], "\n".join(b for b in (" ".join(b.split()) for b in parser.blocks) if b)))
    assert extracted(queries.QUERIES["op11_html_extraction"](spark, sf_dir)) == sorted(expected, key=str)
