"""Pages written for the shapes a result page comes in."""

import gc
import time

import pytest
from pyspark.sql import functions as F

from rankframe.functions.html_scan import scan
from rankframe.functions.page_tree import read_page
from rankframe.operators import pages as P

CAPTURE = "page int, status int, final_url string, html string"


def read(spark, html, status=200, final_url="https://www.google.com/search"):
    return P.extract_serps(spark.createDataFrame([(1, status, final_url, html)], CAPTURE)).first()


def result(i, href, cite="", more=""):
    return (
        f'<div jscontroller="a"><div data-snhf="0"><a data-ved="v{i}" href="{href}"><h3>Title <b>{i}</b></h3>{cite}</a></div>'
        f"<div><span>About <em>thing</em> {i}.</span>{more}</div></div>"
    )


def test_encrypted_links(spark):
    html = "".join(result(i, f"/goto?url={i}", f"<cite>https://h{i}.com<span> › a › b</span></cite>") for i in range(8))
    got = read(spark, html)
    assert got["class"] == "serp" and len(got.results) == 8
    r = got.results[1]
    assert (r.position, r.title, r.host, r.display_path, r.url, r.link, r.form) == (2, "Title 1", "h1.com", "a › b", "", "/goto?url=1", "encrypted")
    assert r.snippet == "About thing 1."


def test_cards_without_h3(spark):
    card = '<li><a data-ved="1" href="https://a{0}.com/"><div role="heading">Card {0}</div></a><div aria-hidden="true">0:59</div><p>Text {0}</p></li>'
    got = read(spark, "<ul>" + "".join(card.format(i) for i in range(10)) + "</ul>")
    assert [r.title for r in got.results] == [f"Card {i}" for i in range(10)]
    assert got.results[3].host == "a3.com" and got.results[3].snippet == "Text 3"


def test_what_is_not_a_result(spark):
    html = (
        result(1, "https://a.com/x", "<cite>20+ comments</cite><cite>https://www.a.com › x</cite>") + result(2, "https://a.com/x")
        + result(3, "https://www.google.com/maps") + result(4, "/goto?e", "<cite>https://maps.google.com</cite>") + result(5, "#top")
        + '<div id="tads"><a data-ved="x" href="https://ad.com/"><h3>Ad</h3></a></div><a data-ved="y" href="https://b.com/">no title</a>'
        + '<script>"<a data-ved=1 href=https://c.com/><h3>x</h3></a>"</script><!-- <a data-ved=1 href="https://d.com"><h3>x</h3></a> -->'
    )
    got = read(spark, html)
    assert [(r.link, r.host) for r in got.results] == [("https://a.com/x", "www.a.com")]


def test_snippets_leave_out_bylines_and_hidden_text(spark):
    more = (
        '<div><div><span data-dtld="x">https://site</span></div>Site name</div><style>p{}</style>'
        '<span style="visibility : hidden">gone</span><span style="color:red">kept</span>'
    )
    assert read(spark, result(1, "https://a.com/", more=more)).results[0].snippet == "About thing 1. kept"


def test_three_kinds_of_ads(spark):
    unit = '<div data-text-ad="1"><a href="/aclk?1">s</a><a data-pcu="https://www.shop{0}.com/p, https://t.net" href="/aclk"><h3>Ad {0}</h3></a><div>Buy {0}</div></div>'
    html = (
        '<div id="bottomads">' + "".join(unit.format(i) for i in range(3)) + '</div><div id="tads">' + "".join(unit.format(i) for i in range(4))
        + '</div><div id="rhs"><a href="/aclk?p"><h3>Thing</h3></a><a href="https://x/aclk"> Two  words </a><a href="/aclk"></a></div>' + result(1, "https://a.com/")
    )
    ads = read(spark, html).ads
    assert [a.placement for a in ads] == ["top"] * 4 + ["bottom"] * 3 + ["product"] * 2
    assert (ads[0].position, ads[0].title, ads[0].host, ads[0].url, ads[0].snippet) == (1, "Ad 0", "www.shop0.com", "https://www.shop0.com/p", "s Buy 0")
    assert [a.title for a in ads[-2:]] == ["Thing", "Two words"] and ads[-1].position == 9


def test_related_and_paging(spark):
    html = result(1, "https://a.com/") + (
        '<div id="botstuff"><a href="/search?q=more+%D0%B8&amp;sa=X">x</a><a href="/search?q=more++%D0%B8">again</a><a href="/search?q=p&amp;tbm=isch">i</a>'
        '<a href="/search?sa=1">none</a><div role="navigation"><a href="/search?q=x&amp;start=10">2</a><a href="/search?q=x&amp;start=30">4</a>'
        '<a href="/search?q=x&amp;tbm=nws">N</a><a href="/search?q=x&amp;start=z">z</a><a id="pnnext" href="/search?q=x&amp;start=10&amp;t=1">Next</a></div></div>'
        '<div id="bres"><a href="/search?q=other">o</a></div>'
    )
    got = read(spark, html)
    assert got.related == ["more и", "other"]
    assert (got.max_offset, got.has_pagination, got.next_page) == (30, True, "/search?q=x&start=10&t=1")
    alone = read(spark, result(1, "https://a.com/") + '<div role="navigation"><a href="/search?q=x&amp;tbm=nws">N</a></div>')
    assert (alone.max_offset, alone.has_pagination, alone.next_page) == (0, False, "")


@pytest.mark.parametrize("html, status, url, kind", [
    (result(1, "https://a.com/") + "unusual traffic from your computer network", 429, "https://x/sorry", "serp"),
    ("x did not match any documents", 200, "https://www.google.com/sorry/index", "wall"), ("x", 429, "", "wall"),
    ("Did Not Match Any Documents. Our systems have detected unusual traffic", 403, "", "empty"), ("НИЧЕГО не найдено", 200, "", "empty"),
    ("Our systems have detected unusual traffic", 403, "", "wall"), ("", 403, "", "banned"), ("", 503, "", "http"), ("/sorry/index", 200, "", "shell"),
    (None, 200, None, "shell"),
])
def test_classes(spark, html, status, url, kind):
    assert read(spark, html, status, url)["class"] == kind


def test_a_long_body_is_read_whole(spark):
    got = read(spark, "<p>" + "x" * (9 * 1024 * 1024) + "</p>" + result(1, "https://a.com/"))
    assert got["class"] == "serp" and got.results[0].title == "Title 1"


@pytest.mark.parametrize("html", ['<a data-ved title="x>' * 50_000, "<a data-ved>" * 90_000, "<a data-ved><h3>x</h3>" + "</p>" * 250_000])
def test_broken_markup_is_read_in_proportion(html):
    began = time.time()
    read_page(html)
    assert len(html) > 999_999 and time.time() - began < 2


def test_odd_quotes_and_links_in_links(spark):
    title = result(1, "https://a.com/").replace("<a ", "<a title=it's ")
    assert [r.link for r in read(spark, title).results] == ["https://a.com/"]
    nested = '<div><a data-ved="1" href="https://a.com/"><b>no title</b><a data-ved="2" href="https://b.com/"><h3>B</h3></a></div>'
    assert [(r.link, r.title) for r in read(spark, nested).results] == [("https://b.com/", "B")]


def test_links_are_classified_once(spark):
    serps = P.extract_serps(spark.createDataFrame([(1, 200, "", "")], CAPTURE))
    plan = P.organic_results(serps, ["page"])._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.splitlines() if "Filter" in x]
    assert len(filters) == 1 and "isnotnull(position" in filters[0]


def test_addresses_are_taken_apart_once_each(spark):
    """A link of each form once where it leads and once for its host, a cite once."""
    serps = P.extract_serps(spark.createDataFrame([(1, 200, "", "")], CAPTURE))
    plan = P.organic_results(serps, ["page"])._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("(?s:.*)$, $1") <= 5


def test_a_remembered_tag_may_go_on_elsewhere():
    """The page ends within a value there, and goes on here."""
    open_value = '<div><a data-ved title="x'
    whole = "<div>" + '<a data-ved title="x><b>" href="/goto?1"><h3>T</h3></a></div>'
    for _ in range(2):
        assert read_page(open_value)["links"] == []
        assert [(k["href"], k["title"]) for k in read_page(whole)["links"]] == [("/goto?1", "T")]


def test_elements_out_of_turn_are_closed_in_turn():
    page = '<div id="rhs"><b><i></b></i></u></div><a data-ved="1" href="/goto?1"><h3>T</i></div></h3></a><p>a < b<5<p>c'
    facts = read_page("<div>" + page + "</div>")
    assert [(k["href"], k["title"]) for k in facts["links"]] == [("/goto?1", "T")]
    assert list(scan("a < b<5<p>c"))[0] == ("text", "a < b<5", "")


def test_offsets_of_any_length(spark):
    bar = '<div role="navigation"><a href="/search?start=%s">2</a><a href="/search?start=30">4</a></div>'
    assert read(spark, result(1, "https://a.com/") + bar % ("9" * 18)).max_offset == int("9" * 18)
    assert read(spark, result(1, "https://a.com/") + bar % "1000000000000000010").max_offset == 1000000000000000010
    assert read(spark, result(1, "https://a.com/") + bar % ("9" * 30)).max_offset == 30


def test_drift(spark):
    rows = [(1, 200, "", result(1, "/goto?x", "<cite>https://www.google.com</cite>")), (2, 200, "", result(1, "https://a.com/")), (3, 500, "", "")]
    serps = P.extract_serps(spark.createDataFrame(rows, CAPTURE)).withColumn("g", F.lit("all"))
    got = P.extraction_drift(serps, ["g"]).first()
    assert (got.pages, got.serps, got.without_results, got.untitled, got.gaps, got.own_hosts) == (3, 2, 1, 0, 0, 0)


def test_a_page_read_leaves_nothing_to_collect():
    """Elements that point at each other would wait for the collector, page after page."""
    page = '<html><body><div id="rso">' + result(1, "https://a.com/") * 30 + "</div></body></html>"
    assert len(read_page(page)["links"]) == 30
    gc.collect()
    gc.disable()
    try:
        read_page(page)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_tags_written_oddly_are_read_as_written():
    page = "a<b c=\"d>e\" f>g<h i = 'j>'><k =\"l>m\">n<o p=q><r\"s>< t <!-- <u> --><v/><w\tx=\"y\"z='>'></W >"
    assert list(scan(page)) == [
        ("text", "a", ""), ("start", "b", ' c="d>e" f'), ("text", "g", ""), ("start", "h", " i = 'j>'"), ("start", "k", ' ="l'),
        ("text", 'm">n', ""), ("start", "o", " p=q"), ("start", 'r"s', ""), ("text", "< t ", ""), ("start", "v", "/"),
        ("start", "w", "\tx=\"y\"z='>'"), ("end", "w", ""),
    ]
