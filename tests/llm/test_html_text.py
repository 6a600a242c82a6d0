import random
import time

import pytest

from rankframe.llm import html_text as H
from rankframe.llm.page_labels import by_markup, laid_out, training_set
from rankframe.llm.page_model import Tree

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return H.trained(spark.read.parquet(f"{FOLDER}/pages.parquet"))


def test_other_layouts_held_out(spark, model):
    pages = [r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").orderBy("page_id").limit(120).collect()]
    articles = [[t for n, t, _ in tree.blocks if y[n]] for tree, y in filter(None, map(by_markup, pages))]
    articles = [a for a in articles if a]
    others, rng = [t for a in articles for t in a], random.Random(1234)
    right = said = wanted = 0
    for article in articles:
        tree, label = laid_out(article, others, rng)
        odds = model.marginals(tree)
        for node, text, _ in tree.blocks:
            said += len(text) * (odds[node] > 0)
            wanted += len(text) * label[node]
            right += len(text) * (odds[node] > 0 and label[node])
    assert right / said > 0.97 and right / wanted > 0.97


def test_the_table_itself(spark, model):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    rows = {r.page_id: r for r in H.main_text(pages, model).collect()}
    same = 0
    for r in pages.collect():
        tree, label = by_markup(r.html)
        same += rows[r.page_id].text == "\n\n".join(t for n, t, _ in tree.blocks if label[n])
        assert rows[r.page_id].n_chars == len(rows[r.page_id].text) and rows[r.page_id].url == r.url
    assert same >= 0.98 * len(rows)


def test_blocks():
    tree = Tree("<p>a <b>b</b>c\n d<br>e<p>f &amp; g<ul><li>h<li>i &lt</ul><script>no</script><!-- no --><style>x</style>j<title>t</title>")
    assert [b[1] for b in tree.blocks] == ["a bc d e", "f & g", "h", "i <", "j"]


def test_long_attributes_are_read_whole():
    short = Tree('<div class="comment" id="sidebar"><p>a b c</p></div>').features()
    for n in (10, 1000, 100_000):
        long = Tree(f'<div class="{"x9 " * n}comment" id="{"x9-" * n}sidebar"><p>a b c</p></div>').features()
        assert (long == short).all()


def test_messages_are_exact():
    """Marginals of a small tree against the sum over all its states."""
    import itertools

    import numpy as np

    from rankframe.llm.page_model import Model

    tree = Tree("<div><p>one</p><section><p>two</p><p>three</p></section></div>")
    n, r = len(tree.tags), np.random.default_rng(2)
    own, edge = r.normal(size=n), [[1.3, 0.2], [0.4, 2.5]]
    model = Model(np.zeros(1), edge)
    tree.features = lambda: own.reshape(-1, 1)
    model.weights = np.ones(1)
    odds = model.marginals(tree)
    total = np.zeros((n, 2))
    for state in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(own[v] for v in range(n) if state[v])) * np.prod([edge[state[tree.parents[v]]][state[v]] for v in range(1, n)])
        for v in range(n):
            total[v, state[v]] += weight
    assert np.allclose(odds, np.log(total[:, 1] / total[:, 0]))


@pytest.mark.parametrize("html", ["<div>" * 60_000 + "x", "</p>" * 200_000, '<a title="x>' * 80_000, "<!--" * 200_000, "<li>a" * 60_000, "a <b " * 100_000])
def test_broken_pages_are_read_in_proportion(model, html):
    began = time.time()
    assert isinstance(model.text(html), str)
    assert time.time() - began < 20


STORY = [
    "The harbour was built in three stages, and each of them took longer than the council had promised to the town.",
    "When the first ships came in, nobody had thought of the tide, so that half of them lay on the sand by evening.",
    "A second wall was added later; it still stands, and on a clear day you can walk along it to the old lighthouse.",
]
# Written by hand: (page, the texts that are its main text).
BY_HAND = [
    (
        '<html><body><nav><a href="/">Home</a> <a href="/news">News</a></nav><div class="content">{0}{1}</div>'
        '<div class="comments"><div class="comment"><p>reader says hi</p></div></div><footer>copyright 2020 the site</footer></body></html>'
    ),
    (
        '<body><div id="header"><h2>My site</h2></div><ul class="menu"><li><a href=a>One</a><li><a href=b>Two</a></ul><main>{0}{1}{2}</main>'
        '<aside><h3>More</h3><p>Read on here.</p></aside><form><p>Sign up for news</p><input><button>Go</button></form></body>'
    ),
    (
        '<body><div class="cookie-notice"><p>We use cookies on this site to count visits.</p></div><div class="wrapper"><div class="post">{0}{1}{2}</div>'
        '<div class="sidebar"><ul><li><a href=x>Old post</a></li><li><a href=y>Older post</a></li></ul></div></div><div id="footer">All rights reserved.</div></body>'
    ),
    (
        '<body><header><a href="/">Logo</a></header><section class="story">{1}{2}</section><div class="ad">Buy one now.</div>'
        '<section id="comments"><div class="comment"><p>I liked this.</p></div><div class="comment"><p>Me too.</p></div></section></body>'
    ),
    '<body><div role="navigation"><a href=1>Start</a></div><div id="main">{0}{2}</div><div class="share"><a href=t>Share</a> <a href=u>Send</a></div></body>',
]


def by_hand(n):
    import re

    page = BY_HAND[n]
    used = [STORY[int(i)] for i in re.findall(r"\{(\d)\}", page)]
    return page.format(*[f"<p>{t}</p>" for t in STORY]), "\n\n".join(used)


def test_pages_written_by_hand(spark, model):
    """By the model of the table, and by one trained on these pages alone, none of which has an article element."""
    pages = [(n, f"u{n}", by_hand(n)[0]) for n in range(len(BY_HAND))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert all("<article" not in p for _, _, p in pages)
    for own in (model, None):
        got = {r.page_id: r.text for r in H.main_text(frame, own).collect()}
        assert got == {n: by_hand(n)[1] for n in range(len(BY_HAND))}


def test_odd_rows(spark, model):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (None, "u", "<p>", "x", 1), (3, "u", "no markup at all", "x", 1), (3, "u", "no markup at all", "x", 1)]
    got = H.main_text(spark.createDataFrame(rows, schema), model).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and [r.text for r in got[:3]] == ["", "", ""]
    assert H.main_text(spark.createDataFrame([], schema)).collect() == []
    bare = H.main_text(spark.createDataFrame(rows, schema)).collect()  # nothing to train on: all text
    assert bare[3].text == "no markup at all"
    assert training_set([], 2, 1) == ([], [])
