"""Main text of pages: the table's own, other layouts, odd input."""

import re
from html import unescape

import pytest
from holdline.llm import common, html_text, queries


def article(html):
    """The text of the article element, as its own pages are built."""
    inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", html or "", re.S)
    text = re.sub(r"</?(p|h1|br|div|ul|li|td|tr)\b[^>]*>", " ", inner[1] if inner else "")
    return " ".join(unescape(re.sub(r"<[^>]*>", "", text)).split())


def test_op1(spark, sf_dir):
    pages = {r["page_id"]: r for r in common.table(spark, sf_dir, "pages").collect()}
    rows = queries.op1_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])
        assert r["url"] == pages[r["page_id"]]["url"]


LAYOUTS = {
    "article": (
        """<body class="has-sidebar comments-open"><div id="cookie-notice"><p>We use cookies.</p></div>
        <header class="site-header"><h1>Site</h1><ul><li><a>Home</a></li></ul></header><div class="content-sidebar-wrap">
        <article><header><h1>Real &eacute; title</h1></header><p>First   para with <a href="x">link words</a> here.</p>
        <div class="ad-slot">Buy cheap things now</div><ul><li>One</li><li>Two</li></ul><p>Short.</p><form><label>Mail</label>
        <p>Subscribe now</p></form><table><tr><td>1</td><td>2</td></tr></table><p>Last para.</p></article>
        <aside><h3>Popular</h3><p>Some sidebar text that is long enough.</p></aside></div><section id="comments">
        <h2>3 comments</h2><article class="c"><p>Great post I like it a lot.</p></article></section>
        <div class="user-comments"><p>Another reader says something.</p></div><footer>&copy; 2020</footer>
        <script>var x="<p>no</p>"</script></body>""",
        "Real é title First para with link words here. One Two Short. 1 2 Last para.",
    ),
    "divisions": (
        """<html><body><div id="header"><a href="/">Site</a> | <a>About</a></div><div id="menu"><a>a</a><a>b</a></div>
        <div id="content"><h2>Heading here</h2><p>Body one.</p><p>Body &lt;two&gt;<br>line.</p></div><div id="sidebar">
        <p>side words</p></div><div class="adsbygoogle">buy</div><div id="footer">foot words</div></body></html>""",
        "Heading here Body one. Body <two> line.",
    ),
    "tables": (
        """<table><tr><td class="left"><a>l1</a><br><a>l2</a></td><td><font><p>Main words of an old page go on.</p>
        <p>More.</p></font></td></tr></table>""",
        "Main words of an old page go on. More.",
    ),
    "roles": (
        """<body><header><h1>Site</h1><p>tagline words</p></header><div role="navigation"><a>n</a></div><div role="main">
        <p>Main.</p><dl><dt>t</dt><dd>d words</dd></dl></div><div role="complementary"><p>side words</p></div>
        <div role="contentinfo">foot</div><div class="notification">We updated the policy</div></body>""",
        "Main. t d words",
    ),
    "entry": (
        """<main><article class="post-12 type-post"><div class="entry-header"><h1>T one</h1><span class="author">By Jo</span>
        </div><div class="entry-content"><p>P1 words.</p><figure><img><figcaption>Caption</figcaption></figure><pre>code  x
        </pre><div class="promo">Join us now today</div><p>P2.</p></div><footer class="entry-footer">Posted in <a>x</a></footer>
        </article><div id="disqus_thread">c c c c</div><ol class="commentlist"><li>Comment number one</li></ol></main>""",
        "T one By Jo P1 words. Caption code x P2.",
    ),
    "plain": ("<div><div>Plain text of a page.</div><div>More here <a>link</a>.</div></div>", "Plain text of a page. More here link ."),
    "hidden": ('<p>Seen</p><p style="display: none">not</p><p hidden>nor this</p><noscript><p>x</p></noscript>', "Seen"),
    "unclosed": ("<article><h1>A<p>one <b>two<p>three<!-- x <p>no</p> --> four", "A one two three four"),
    "references": ("<p>a&nbsp;&amp;lt; &#233;&#x4e2d; &copy &bogus;</p>", "a &lt; é中 © &bogus;"),
    "quotes": ("""<p title="a > b" class='x'>in</p><p class="open>text</p>""", "in text"),
    "raw": ("<title>no</title><textarea><p>no</textarea><style>p{}</style><p>yes<script>if(a<b)</script></p>", "yes"),
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    html, want = LAYOUTS[name]
    got = html_text.main_text(html, html_text.default_weights())
    assert got.replace(" .", ".") == want.replace(" .", ".")


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a b</p>"), (3, "u", "<p>a"), (3, "u", "<p>a"), (4, "u", "<b>" * 20_000 + "x"),
            (5, "u", "<p>" + "word " * 200_000 + "</p>"), (6, "u", "<" * 5000), (7, "u", "plain &amp; text")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r["page_id"], r["text"]) for r in got.collect() if r["page_id"] not in (5, 6)}
    assert found == {(1, ""), (2, ""), (None, "a b"), (3, "a"), (4, "x"), (7, "plain & text")}
    assert got.count() == 9 and html_text.extract(pages.limit(0)).count() == 0
    assert got.filter("page_id = 5").first()["n_chars"] == 200_000 * 5 - 1


def test_own_labelled_pages():
    page = '<div class="zone" data-main><p>{}</p></div><div class="rail"><p>{}</p></div>'
    weights = html_text.fit([page.format("word " * 20, "word " * 9)] * 3)
    assert html_text.main_text(page.replace(" data-main", "").format("mine " * 5, "other " * 5), weights) == " ".join(["mine"] * 5)


def test_weights_have_the_stated_signs():
    weights = html_text.default_weights()
    assert all(w < 0 for w in weights.tags.values()) and weights.other_tag < 0
    assert weights.tags["p"] > weights.tags["a"]
