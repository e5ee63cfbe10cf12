"""Small labelled pages on which the extraction model is trained.

Elements carry ``data-y``: c for content, b for boilerplate, m for a mix of both; inner elements inherit c and b.
"""

from __future__ import annotations

import random

# Wrappers that hold the article, and those that hold everything else, as seen on public pages.
CONTENT = [
    "article", "main", "div class='content'", "div id='main-content'", "div class='post body'", "section class='story'",
    "div class='entry content'", "div class='article text'", "div id='content'", "div class='page text'", "td class='text'",
    "section", "div", "div role='main'", "article class='post'", "div itemprop='articleBody'",
]
LINKS = [
    "nav", "div class='menu'", "ul class='nav navigation'", "div class='breadcrumbs'", "aside class='sidebar'",
    "div class='sidebar widget'", "div class='related links'", "div class='share social'", "div class='tags'", "header class='top'",
    "div id='header'", "footer", "div class='footer links'", "div class='pagination pager'", "div id='navbar'", "ul class='menu'",
    "div class='tabs'", "div role='navigation'", "section class='recommended'",
]
PROSE = [
    "div class='ad'", "div class='ads advert'", "div class='banner promo'", "div class='sponsored'", "aside", "footer",
    "div class='footer copyright'", "div class='cookie notice'", "div class='notice alert'", "div class='popup overlay modal'",
    "div class='comments'", "section id='comments'", "div class='comment reply'", "ol class='commentlist'", "header",
    "div class='newsletter subscribe'", "form", "form class='search'", "div class='login signup'", "div class='disclaimer'",
    "div role='alert'", "div role='complementary'", "div class='author bio'", "div id='sidebar'", "section class='discussion responses'",
    "div class='warning message'", "div class='consent gdpr privacy'",
]
#: One page in so many has its article's elements right in the body, half of these nothing else.
BARE = 5
HIDDEN = ["script", "style", "noscript", "template", "svg", "iframe"]


def labelled_pages(n: int = 1500, seed: int = 3) -> list[str]:
    draw = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("x" * draw.randint(2, 9) for _ in range(draw.randint(low, high))) + "."

    def wrap(tag: str, y: str, inner: str) -> str:
        return f"<{tag} data-y={y}>{inner}</{tag.split()[0]}>"

    def links() -> str:
        items = [f"<a href='/'>{words(1, 4)}</a>" for _ in range(draw.randint(1, 9))]
        return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>" if draw.random() < 0.6 else " ".join(items)

    def prose(low: int, high: int) -> str:
        kinds = [lambda: f"<p>{words(low, high)}</p>"] * 6 + [
            lambda: words(low, high) + "<br>", lambda: f"<p>{words(low, high)} <a href='/'>{words(1, 3)}</a> {words(low, high)}</p>",
            lambda: f"<div>{words(low, high)}</div>", lambda: f"<li>{words(low, high)}</li>"]
        return "".join(draw.choice(kinds)() for _ in range(draw.randint(1, 4)))

    def boilerplate() -> str:
        if draw.random() < 0.5:
            return wrap(draw.choice(LINKS), "b", links())
        return wrap(draw.choice(PROSE), "b", prose(2, 25))

    def article(bare: bool = False) -> str:
        """An article, or with ``bare`` its elements without anything around them, at times of plain divisions."""
        block = "div" if bare and draw.random() < 0.4 else "p"
        parts = [f"<h1>{words(2, 8)}</h1>"] if draw.random() < 0.8 else []
        for _ in range(draw.choice([1, 2, 4, 8, 16])):
            kind = draw.random()
            if kind < 0.72:
                parts.append(f"<{block}>{words(1, draw.choice([3, 30, 120]))}</{block}>")
            elif kind < 0.8:
                parts.append(f"<h2>{words(1, 6)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{words(2, 15)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{words(5, 40)}</blockquote>")
            elif kind < 0.94:
                parts.append(f"<table><tr><td>{words(1, 5)}</td><td>{words(1, 5)}</td></tr></table>")
            else:
                parts.append(boilerplate())
        if bare:
            return "".join(p if " data-y=b>" in p.split("<", 2)[1] else p.replace(">", " data-y=c>", 1) for p in parts)
        inner = "".join(parts)
        if draw.random() < 0.2:
            inner = wrap("div", "c", inner)
        return wrap(draw.choice(CONTENT), "c", inner)

    pages = []
    for k in range(n):
        parts = [boilerplate() for _ in range(draw.randint(0, 3))] + [article(k % BARE == 0)] + [boilerplate() for _ in range(draw.randint(0, 4))]
        if k % (2 * BARE) == 0:
            parts = [article(True)]  # a page of nothing else
        if draw.random() < 0.1:
            parts.insert(0, article())
        body = "".join(parts)
        if draw.random() < 0.4:
            body = wrap(draw.choice(["div", "div class='page'", "div id='wrapper'", "div class='container'"]), "m", body)
        pages.append(f"<html data-y=m><head data-y=b><title>{words(2, 5)}</title></head><body data-y=m>{body}</body></html>")
    return pages
