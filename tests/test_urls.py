"""Addresses and links, case by case."""

import pytest
from pyspark.sql import functions as F

from rankframe.functions import urls as U


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "c string").select(column(F.col("c")).alias("x")).first().x


@pytest.mark.parametrize("typed, site", [
    ("https://www.Example.com/path?q#f", "example.com"), ("  EXAMPLE.com. ", "example.com"),
    ("example.com:8080/x", "example.com:8080"), ("", ""), ("//host/x", ""), ("www.a.b", "a.b"),
])
def test_normalise_site(spark, typed, site):
    assert one(spark, U.normalise_site, typed) == site


@pytest.mark.parametrize("raw, canonical", [
    ("https://www.Example.com/Path/?Q=1#frag", "example.com/Path?Q=1"),
    ("HTTP://user:pw@Example.com:8080/a/", "example.com/a"),
    ("http://пример.рф/путь/", "пример.рф/%D0%BF%D1%83%D1%82%D1%8C"),
    ("https://a.com/b c", "a.com/b%20c"), ("https://a.com/b%20c", "a.com/b%20c"),
    ("https://a.com/(x)", "a.com/(x)"), ("https://a.com/(x) y", "a.com/%28x%29%20y"),
    ("//host/x//", "host/x/"), ("A.com/X", "a.com/x"), ("", ""), ("https://h.com/%ZZ", "https://h.com/%zz"),
    ("https://h.com:port/x", "https://h.com:port/x"), ("http://[::1]:80/x", "::1/x"), ("https://a.com?b=/", "a.com?b=/"),
])
def test_canonical_url(spark, raw, canonical):
    assert one(spark, U.canonical_url, raw) == canonical


def test_canonical_host(spark):
    assert one(spark, U.canonical_host, "https://WWW.A.com:1/x") == "a.com"
    assert one(spark, U.canonical_host, "www.A.com/x") == "a.com"


@pytest.mark.parametrize("site, url, host", [
    ("example.com", "", "example.com"), ("https://www.example.com/", "", "example.com"),
    ("example.com/p", "https://example.com/p", "example.com"), ("a.com:80", "", "a.com"), ("a b", "", "a b"),
])
def test_split_site(spark, site, url, host):
    got = one(spark, U.split_site, site)
    assert (got.want_url, got.want_host) == (url, host)


@pytest.mark.parametrize("host, want, yes", [
    ("example.com", "example.com", True), ("www.a.example.com", "example.com", True),
    ("notexample.com", "example.com", False), ("example.com.evil.org", "example.com", False), ("", "a", False), ("a", "", False),
])
def test_host_belongs_to(spark, host, want, yes):
    assert one(spark, lambda c: U.host_belongs_to(c, F.lit(want)), host) is yes
    assert (want in one(spark, U.host_suffixes, host)) is yes


@pytest.mark.parametrize("host, own", [
    ("google.com", True), ("www.google.co.uk", True), ("maps.google.de.", True), ("google.example.com", False),
    ("google.myshop.com", False), ("notgoogle.com", False), ("google", False), ("google.com.br", True), ("", False),
])
def test_is_engine_host(spark, host, own):
    assert one(spark, U.is_engine_host, host) is own


@pytest.mark.parametrize("href, dest, form", [
    ("/goto?url=abc", "", "encrypted"), ("/url?q=https%3A%2F%2Fa.b%2Fc%3Fd%3D1&x=2", "https://a.b/c?d=1", "redirect"),
    ("/url?q=https://www.google.com/x&url=https://a.b/", "https://a.b/", "redirect"), ("/url?q=/relative", "", ""),
    (" https://a.b/c ", "https://a.b/c", "direct"), ("https://www.google.com/maps", "", ""), ("/search?q=x", "", ""),
    ("", "", ""), ("#top", "", ""), ("https://google.example.com/", "https://google.example.com/", "direct"),
])
def test_classify_link(spark, href, dest, form):
    got = one(spark, U.classify_link, href)
    assert (got.dest, got.form, got.ok) == (dest, form, form != "")


@pytest.mark.parametrize("url, page", [
    ("https://translate.google.com/translate?hl=en&u=https://a.b/c", "https://a.b/c"),
    ("https://translate.google.com/translate?u=https://www.google.com/", None),
    ("https://my--site-example-com.translate.goog/p/a?_x_tr_sl=en&b=2&a=1", "https://my-site.example.com/p/a?a=1&b=2"),
    ("https://www-google-com.translate.goog/x", None), ("https://a.b/", None),
])
def test_untranslated(spark, url, page):
    assert one(spark, U.untranslated, url) == page


@pytest.mark.parametrize("origin, link, url, error", [
    ("https://www.google.de", "/goto?x", "https://www.google.de/goto?x", None), ("", "https://a.b/", "https://a.b/", None),
    ("", "/goto?x", None, "no origin"), ("https://g.de/a/b", "c", "https://g.de/a/c", None), ("https://g.de", "//h/x", "https://h/x", None),
])
def test_absolute_link(spark, origin, link, url, error):
    got = one(spark, lambda c: U.absolute_link(F.lit(origin), c), link)
    assert (got.url, got.error) == (url, error)


def test_search_url(spark):
    def asked(text, country, language, page):
        return one(spark, lambda c: U.search_url(c, F.lit(country), F.lit(language), F.lit(page)), text)

    assert asked(" a b&c ", "DE", "en", 3) == "https://www.google.de/search?gl=de&hl=en&q=a+b%26c&start=20"
    assert asked("x", "zz", "", 1) == "https://www.google.com/search?gl=zz&q=x"
    assert asked("~*'", "", "", 1) == "https://www.google.com/search?q=~%2A%27"
    assert asked("  ", "", "", 1) is None


def test_smaller_ones(spark):
    assert one(spark, U.site_query, "https://www.A.com/p/?q=1") == "site:a.com/p"
    assert one(spark, U.site_of, " https://www.A.com:443/x ") == "a.com"
    assert one(spark, lambda c: U.displayed_link(c, F.lit("p"), F.lit("http://x/")), "h.com") == "http://h.com › p"


@pytest.mark.parametrize("message, kind", [
    ('search "q": refused (class wall)', "wall"), ('search "(class wall)": timeout', None), ("x (class wall) y (class shell)", "shell"),
    ("x (class odd)", None), ("(class wall)", None), ("", None),
])
def test_class_in_text(spark, message, kind):
    assert one(spark, U.class_in_text, message) == kind
