"""Labelled pages from which the weights of the extraction are learned.

Each page is built from one layout: what holds the main text, and what stands around it.
Elements that hold main text carry ``data-main``, those within
them that do not ``data-main="no"``. The names are those that authoring
tools and style guides commonly use; a user with labelled pages of their own passes
them to ``html_text.fit`` instead.
"""

from __future__ import annotations

from itertools import cycle

# Names of elements and classes that hold main text, and that do not.
MAIN = (
    "article", "main", "div.content", "div.post", "div.entry", "div.story", "div.text", "div.body",
    "section.page", "div#main", "td", "div", "section", "div.article", "div.blog", "div",
)
LINKS = (
    "nav", "div.menu", "div.nav", "ul.navigation", "div.breadcrumb", "div.pagination", "div.related",
    "div.tags", "div.share", "div.social", "div.sitemap", "div.toolbar", "div.pager", "div", "td", "section",
)
PROSE = (
    "header", "footer", "aside", "div.ad", "div.ads", "div.advert", "div.advertisement", "div.banner",
    "div.sponsor", "div.sponsored", "div.promo", "div.sidebar", "div.notice", "div.cookie", "div.consent",
    "div.newsletter", "div.subscribe", "div.comment", "section.comments", "div.reply", "div.disclaimer",
    "div.copyright", "div.footer", "div.header", "div.masthead", "div.widget", "div.popup", "div.modal",
    "div.alert", "div.login", "div.signup", "div.legal", "div.privacy", "div.feedback", "div.discussion",
    "div.responses", "div.disqus", "div.overlay", "div.gdpr", "div.announcement", "div.teaser", "div.recommended",
    "form", "div.form", "div.search", "div.aside", "div.warning", "div.message", "div.skip",
    "div.complementary", "div.contentinfo", "div.dialog", "div.notification", "div.adsbygoogle", "div.adsense",
    "div.related", "div.trending", "div.outbrain", "div.taboola", "div.hidden", "div.donate", "div.paywall",
)


def _element(name: str, inner: str, more: str = "") -> str:
    tag, cls, own = name, "", ""
    if "#" in name:
        tag, own = name.split("#")
    elif "." in name:
        tag, cls = name.split(".")
    attributes = (f' class="{cls}"' if cls else "") + (f' id="{own}"' if own else "") + more
    return f"<{tag}{attributes}>{inner}</{tag}>"


def _prose(n: int) -> str:
    return "".join(f"<p>{'word ' * 15}<a>word</a> <a>word</a>{' word' * 15}</p>" for _ in range(n))


def labelled_pages() -> list[str]:
    """Pages for each name of other text: beside the main text, as a part of it, and as
    a part named after it. The other names come in turn."""
    mains, links = cycle(MAIN), cycle(LINKS)
    menu = "".join('<li><a href="#">word word</a></li>' for _ in range(6))
    lists = f"<ul><li>{'word ' * 8}</li><li>word word</li></ul><blockquote>{'word ' * 9}</blockquote>"
    table = f"<table><tr><td>{'word ' * 3}</td></tr></table>word word word"
    linked = '<p><a href="#">word word word</a></p>'
    pages = []
    for prose in (p for p in PROSE for _ in range(5)):
        main, link = next(mains), next(links)
        around = f"<p>{'word ' * 12}</p><div>{'word ' * 6}</div><ul><li>word word</li></ul>{'word ' * 4}"
        named = "div.content-" + prose.split(".")[-1]
        own = linked if main in ("article", "main") else ""
        parts = (
            f"<h1>{'word ' * 5}</h1>" + _prose(1),
            _element(prose, around, ' data-main="no"') if prose != "header" else "",
            _prose(1) + lists,
            _element(named, around, ' data-main="no"'),
            _element(link, f"<ul>{menu}</ul>", ' data-main="no"') if link not in MAIN else "",
            own + f"<h2>word word</h2>{_prose(1)}<div>{'word ' * 20}<div>{'word ' * 9}</div></div>" + table,
        )
        pages.append(
            "<html><body>"
            + _element(link, menu if link.startswith("ul") else f"<ul>{menu}</ul>")
            + _element(main, "".join(parts), " data-main")
            + _element(prose, around)
            + f'<div><a href="#">word word</a></div></body></html>'
        )
    return pages
