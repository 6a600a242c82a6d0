"""Labelled pages to train on: the article of a page as its markup says, and the
same article laid out anew among the parts that other sites have."""

import random

import numpy as np

from rankframe.llm.page_model import Tree

# Parts of a page that are not its article: how they are marked, in one of these ways.
PARTS = {
    "nav": ["<nav>", '<div class="menu">', '<div id="navigation">', '<ul class="navbar">', '<div role="navigation">', '<div class="breadcrumbs">'],
    "header": ["<header>", '<div id="header">', '<div class="masthead">', '<div class="site-header top">', '<div class="banner">'],
    "notice": ['<div class="cookie-notice">', '<div id="consent">', '<div class="notification">', '<div class="warning notice">', '<section class="privacy">'],
    "ad": ['<div class="ad">', '<div class="advert">', '<div id="sponsored">', '<aside class="promo">', '<div class="banner ads">', '<p class="sponsor">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="side">', '<div class="widget">', '<section class="trending">'],
    "form": ["<form>", '<form class="search">', '<div class="newsletter signup">', '<div class="subscribe">', '<div id="login">'],
    "comments": ['<section id="comments">', '<div class="comments">', '<div class="discussion">', '<ol class="responses">', '<div class="replies">'],
    "related": ['<div class="related">', '<section class="recommended">', '<ul class="teaser">', '<div class="links">'],
    "share": ['<div class="share">', '<div class="social sharing">', '<ul class="toolbar">', '<div class="tags">'],
    "footer": ["<footer>", '<div id="footer">', '<div class="site-footer">', '<div class="copyright">', '<div class="legal bottom">'],
}
ARTICLE = [
    "<article>", "<main>", '<div class="content">', '<div class="post">', '<div class="entry-content">', '<section class="story">',
    '<div id="main">', '<div class="article-body">', '<div class="text">', '<div class="blog-post">', "<section>", "<div>",
]
# A long paragraph, in characters, and pages laid out where none is marked.
LONG, LEAST_LAID_OUT = 80, 300
BEFORE, AFTER = ("nav", "header", "notice", "ad", "share"), ("side", "form", "comments", "related", "share", "ad", "footer")


def _end(start: str) -> str:
    return f"</{start[1:-1].split()[0]}>"


def _words(text: str, n: int, rng: random.Random) -> str:
    words = text.split() or ["text"]
    at = rng.randrange(max(1, len(words) - n))
    return " ".join(words[at : at + n])


def _part(kind: str, others: list[str], rng: random.Random) -> str:
    """One part, its elements marked as no content."""
    start = rng.choice(PARTS[kind])
    some = lambda low, high: _words(rng.choice(others), rng.randint(low, high), rng)
    link = lambda: f'<a href="/x">{some(1, 4)}</a>'
    if kind in ("nav", "share") or (kind in ("side", "related", "footer") and rng.random() < 0.5):
        items = "".join(f"<li>{link()}</li>" for _ in range(rng.randint(2, 8)))
        inner = items if start.startswith(("<ul", "<ol")) else f"<ul>{items}</ul>"
    elif kind == "form":
        inner = f"<p>{some(2, 12)}</p><input name=q><button>{some(1, 2)}</button>"
    elif kind == "comments":
        tag = "li" if start.startswith("<ol") else "div"
        inner = "".join(f'<{tag} class="comment"><p>{some(3, 60)}.</p></{tag}>' for _ in range(rng.randint(1, 5)))
    elif kind == "footer":
        inner = f"&copy; {some(1, 3)} &middot; {some(3, 14)}."
    elif kind == "header" and rng.random() < 0.7:
        level = rng.choice(("h1", "h2", "h2", "h3"))
        inner = f"<{level}>{some(1, 5)}</{level}>"
    elif kind == "side":
        inner = f"<h3>{some(1, 4)}</h3><p>{some(5, 40)}.</p>"
    else:
        inner = f"{some(2, 20)}." if rng.random() < 0.6 else f"<p>{some(2, 25)}.</p>"
    return start + inner + _end(start)


def _article(paragraphs: list[str], others: list[str], rng: random.Random) -> str:
    start = rng.choice(ARTICLE)
    body = []
    if rng.random() < 0.8:
        level = rng.choice(("h1", "h1", "h2"))
        body.append(f"<{level}>{_words(paragraphs[0], 8, rng)}</{level}>")
    for text in paragraphs:
        tag = rng.choices(("p", "div", "blockquote", "li"), (20, 2, 1, 1))[0]
        body.append(f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag}>{text}</{tag}>")
        if rng.random() < 0.08:
            body.append(f"<h2>{_words(text, 4, rng)}</h2>")
        if rng.random() < 0.06:
            body.append(f'<div data-part="0">{_part(rng.choice(("ad", "share", "related")), others, rng)}</div>')
    return f'<div data-part="1">{start}{"".join(body)}{_end(start)}</div>'


def laid_out(paragraphs: list[str], others: list[str], rng: random.Random) -> tuple[Tree, np.ndarray]:
    """The article among other parts, and the label of every element."""
    part = lambda k: f'<div data-part="0">{_part(k, others, rng)}</div>'
    before = [part(k) for k in BEFORE if rng.random() < 0.5]
    after = [part(k) for k in AFTER if rng.random() < 0.45]
    rng.shuffle(before)
    middle = _article(paragraphs, others, rng)
    if rng.random() < 0.4:
        middle = f'<div class="{rng.choice(("wrapper", "page", "site wrap", "row"))}">{middle}</div>'
    page = "<html><head><title>t</title></head><body>" + "".join(before) + middle + "".join(after) + "</body></html>"
    tree = Tree(page)
    return tree, _labels(tree, lambda v: 'data-part="1"' in tree.raws[v], lambda v: 'data-part="0"' in tree.raws[v])


def by_markup(page: str) -> tuple[Tree, np.ndarray] | None:
    """A page with one article element, labelled by it; None for any other page."""
    tree = Tree(page)
    if tree.tags.count("article") != 1 or not tree.blocks:
        return None
    return tree, _labels(tree, lambda v: tree.tags[v] == "article", lambda v: tree.tags[v] in ("nav", "aside", "footer", "form"))


def _labels(tree: Tree, begins, ends) -> np.ndarray:
    labels = np.zeros(len(tree.tags), int)
    for v in range(1, len(tree.tags)):
        labels[v] = 1 if begins(v) else 0 if ends(v) else labels[tree.parents[v]]
    return labels


def long_paragraphs(page: str) -> list[str]:
    """The page's texts of ``LONG`` characters or more that are not mostly links."""
    return [text for _, text, linked in Tree(page).blocks if len(text) >= LONG and 3 * linked < len(text)]


def training_set(pages: list[str], layouts: int, seed: int) -> tuple[list[Tree], list[np.ndarray]]:
    """Each page by its markup, and its article laid out ``layouts`` times. Where
    no page marks its article, the long paragraphs of a page take its place, and
    are laid out often enough to make ``LEAST_LAID_OUT`` pages."""
    rng = random.Random(seed)
    marked = [m for m in map(by_markup, pages) if m is not None]
    articles = [[text for node, text, _ in tree.blocks if label[node]][:40] for tree, label in marked]
    if not marked:
        articles = [long_paragraphs(page)[:40] for page in pages]
    articles = [a for a in articles if a]
    if not marked and articles:
        layouts = max(layouts, -(-LEAST_LAID_OUT // len(articles)))
    others = [text for a in articles for text in a] or ["text"]
    pairs = marked + [laid_out(a, others, rng) for a in articles for _ in range(layouts)]
    return [t for t, _ in pairs], [y for _, y in pairs]
