"""Addresses as native columns: canonical forms, site matching, link forms.

An address is split with one expression rather than ``parse_url``, which gives
nothing for international hosts and for paths with a space in them.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as trimmed from the ends of a text.
SPACES = "\t\n\x0b\x0c\r \x85\xa0" + "".join(
    map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
)
SPACE_RUN = r"[\s\x{85}\p{Z}]+"

_SPLIT = (
    r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?//"  # scheme
    r"(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:@\[\]]*)(?::\d*)?(?=[/?#]|$)"  # host and port
    r"([^?#]*)(?:\?([^#]*))?"  # path and query
)
# What an address may not hold: control characters, a broken escape in the
# path, a blank or quoting mark in the host.
_UNREADABLE = r"[\x00-\x1f\x7f]|^[^?#]*%(?![0-9A-Fa-f]{2})|^[^/]*//[^/?#]*[\s<>\"\\^`{|}]"
# Characters a path is re-written for; anything else is left as it was typed.
_PATH_REWRITE = r"[^A-Za-z0-9\-_.~!$&'()*+,;=:@/%\[\]]"

# The second-level labels that make a two-label public suffix.
SUFFIX_LABELS = ("co", "com", "net", "org", "ac")
# Country -> the engine's domain there.
COUNTRY_DOMAINS = {
    "ru": "www.google.ru", "de": "www.google.de", "fr": "www.google.fr", "es": "www.google.es",
    "it": "www.google.it", "nl": "www.google.nl", "pl": "www.google.pl", "tr": "www.google.com.tr",
    "br": "www.google.com.br", "uk": "www.google.co.uk", "gb": "www.google.co.uk",
    "ua": "www.google.com.ua", "kz": "www.google.kz", "by": "www.google.by",
    "jp": "www.google.co.jp", "in": "www.google.co.in", "au": "www.google.com.au",
    "ca": "www.google.ca", "us": "www.google.com",
}
DEFAULT_DOMAIN = "www.google.com"
RESULTS_PER_PAGE = 10
# The classes a response can have.
CLASSES = ("serp", "empty", "shell", "wall", "banned", "http")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """A column worked out once and used several times in one expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    """A text without white space at its ends."""
    return F.btrim(_col(c), F.lit(SPACES))


# One pass over an address: scheme, host, path and query, marked off by a
# character no readable address holds.
_MARK = "\x01"
_PARTS = _SPLIT + r"(?s:.*)$"


def url_parts(c: Column | str) -> Column:
    """An address taken apart once: array of scheme, host, path and query;
    null where it does not read as an address that names a host."""
    c = _col(c)
    cut = F.split(F.regexp_replace(c, _PARTS, f"$1{_MARK}$2{_MARK}$3{_MARK}$4"), _MARK, 4)
    return let(cut, lambda p: F.when((F.size(p) == 4) & (F.get(p, F.lit(1)) != "") & ~c.rlike(_UNREADABLE), p))


def _part(p: Column, at: int) -> Column:
    return F.get(p, F.lit(at))


def _host_of(p: Column) -> Column:
    return F.btrim(_part(p, 1), F.lit("[]"))


def _path_of(p: Column) -> Column:
    raw = _part(p, 2)
    return F.when(raw.rlike(_PATH_REWRITE), path_encode(percent_decode(raw))).otherwise(raw)


def readable(c: Column | str) -> Column:
    """Whether a text reads as an address that names a host."""
    return url_parts(c).isNotNull()


def url_scheme(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(c), _SPLIT, 1))


def url_host(c: Column | str) -> Column:
    """The host of an address without port or brackets, '' where it has none."""
    return let(url_parts(c), lambda p: F.when(p.isNotNull(), _host_of(p)).otherwise(F.lit("")))


def schemed_host(c: Column | str) -> Column:
    """The host of an address that names its scheme too, else null."""
    return let(url_parts(c), lambda p: F.when(p.isNotNull() & (_part(p, 0) != ""), _host_of(p)))


def url_query(c: Column | str) -> Column:
    return F.regexp_extract(_col(c), _SPLIT, 4)


def percent_decode(c: Column) -> Column:
    """Escapes read back; a plus sign stays one. Null for a broken escape."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def form_decode(c: Column) -> Column:
    return F.try_url_decode(c)


def form_encode(c: Column) -> Column:
    """Query encoding: blanks as plus signs, only letters, digits and -_.~ plain."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def path_encode(c: Column) -> Column:
    out = F.replace(form_encode(c), F.lit("+"), F.lit("%20"))
    for plain in "$&+,/:;=@":
        out = F.replace(out, F.lit(f"%{ord(plain):02X}"), F.lit(plain))
    return out


def url_path(c: Column | str) -> Column:
    """The path as an address carries it, raw blanks and letters escaped."""
    raw = F.regexp_extract(_col(c), _SPLIT, 3)
    return F.when(raw.rlike(_PATH_REWRITE), path_encode(percent_decode(raw))).otherwise(raw)


def _bare(host: Column) -> Column:
    """A host in lower case without its last dot and a leading www."""
    host = F.lower(host)
    undotted = let(host, lambda h: F.when(h.endswith("."), F.substring(h, F.lit(1), F.length(h) - 1)).otherwise(h))
    return let(undotted, lambda h: F.when(h.startswith("www."), F.substring(h, F.lit(5), F.length(h))).otherwise(h))


def normalise_site(c: Column | str) -> Column:
    """A site as typed, reduced to its host; a port is kept."""
    return _bare(F.regexp_extract(strip(c), r"^(?:(?s:.*?)://)?([^/?#]*)", 1))


def canonical_url(c: Column | str) -> Column:
    """The one spelling two addresses are compared by; path case is kept."""

    def spelled(typed: Column, p: Column) -> Column:
        path, query = _path_of(p), _part(p, 3)
        path = let(path, lambda x: F.when(x.endswith("/"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))
        tail = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
        return F.when(p.isNotNull(), F.concat(_bare(_host_of(p)), path, tail)).otherwise(F.lower(typed))

    return let(strip(c), lambda typed: let(url_parts(typed), lambda p: spelled(typed, p)))


def canonical_host(c: Column | str) -> Column:
    """The site an address or a bare host belongs to."""
    return let(
        strip(c),
        lambda typed: let(url_parts(typed), lambda p: F.when(p.isNotNull(), _bare(_host_of(p))).otherwise(normalise_site(typed))),
    )


def same_url(a: Column | str, b: Column | str) -> Column:
    return canonical_url(a) == canonical_url(b)


def _with_scheme(c: Column) -> Column:
    return F.when(c.contains("://"), c).otherwise(F.concat(F.lit("https://"), c))


def split_site(c: Column | str) -> Column:
    """What a site question asks: struct(want_url, want_host). A path makes it
    a question about a page, anything else one about the site."""
    c = _col(c)

    def asked(typed: Column, p: Column) -> Column:
        paged = p.isNotNull() & (F.btrim(_part(p, 2), F.lit("/")) != "")
        return F.struct(
            F.when(paged, typed).otherwise(F.lit("")).alias("want_url"),
            F.when(p.isNotNull(), _bare(_host_of(p))).otherwise(normalise_site(c)).alias("want_host"),
        )

    return let(_with_scheme(c), lambda typed: let(url_parts(typed), lambda p: asked(typed, p)))


def host_belongs_to(host: Column | str, want: Column | str) -> Column:
    """Whether a host is the site or one of its subdomains, label by label."""
    host, want = normalise_site(host), _col(want)
    inside = (host == want) | F.endswith(host, F.concat(F.lit("."), want))
    return F.when((host == "") | (want == ""), F.lit(False)).otherwise(inside)


def host_suffixes(host: Column | str) -> Column:
    """A host and every domain above it: the sites it belongs to. Turns "is it
    this site or below it" into equality, so matching sites is a hash join."""
    labels = F.split(normalise_site(host), r"\.")
    above = let(
        labels,
        lambda l: F.transform(F.sequence(F.lit(1), F.size(l)), lambda i: F.array_join(F.slice(l, i, F.size(l)), ".")),
    )
    return F.array_remove(above, "")


def site_query(c: Column | str) -> Column:
    """The index question for an address: site: with host and path."""
    def asked(p: Column) -> Column:
        path = F.regexp_replace(_path_of(p), r"/+\z", "")
        return F.when(p.isNotNull(), F.concat(_bare(_host_of(p)), path)).otherwise(normalise_site(c))

    return F.concat(F.lit("site:"), let(_with_scheme(strip(c)), lambda typed: let(url_parts(typed), asked)))


def is_engine_host(c: Column | str) -> Column:
    """Whether a host is the search engine's own: its label stands directly
    left of the public suffix."""
    labels = F.split(F.lower(F.regexp_replace(strip(c), r"\.\z", "")), r"\.")

    def own(labels: Column) -> Column:
        one = F.try_element_at(labels, F.lit(-2)) == "google"
        two = (F.try_element_at(labels, F.lit(-3)) == "google") & F.try_element_at(labels, F.lit(-2)).isin(*SUFFIX_LABELS)
        return F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False))

    return let(labels, own)


def _away(value: Column) -> Column:
    """An address that leads off the engine, else null."""
    return let(value, lambda v: let(url_parts(v), lambda p: F.when(p.isNotNull() & ~is_engine_host(_host_of(p)), v)))


def query_parameter(query: Column, name: str) -> Column:
    """The first value of a parameter in a query text, '' where it is absent."""
    return F.coalesce(form_decode(F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)), F.lit(""))


def classify_link(c: Column | str) -> Column:
    """What a result's href is: struct(dest, form, ok)."""
    def dest(href: Column) -> Column:
        query = F.regexp_extract(href, r"^[^?#]*\?([^#]*)", 1)
        redirect = F.coalesce(_away(query_parameter(query, "q")), _away(query_parameter(query, "url")))
        return (
            F.when(href.startswith("/goto"), "")
            .when(href.startswith("/url"), redirect)
            .when(href.rlike("^https?://"), _away(href))
        )

    def link(href: Column, dest: Column) -> Column:
        form = F.when(href.startswith("/goto"), "encrypted").when(href.startswith("/url"), "redirect").otherwise("direct")
        return F.struct(
            F.coalesce(dest, F.lit("")).alias("dest"),
            F.when(dest.isNotNull(), form).otherwise("").alias("form"),
            dest.isNotNull().alias("ok"),
        )

    return let(strip(c), lambda href: let(dest(href), lambda d: link(href, d)))


def untranslated(c: Column | str) -> Column:
    """The page a link through the engine's translator leads to, else null."""
    c = _col(c)
    host = F.lower(url_host(c))
    asked = query_parameter(url_query(c), "u")
    by_parameter = F.when(
        url_scheme(asked).isin("http", "https") & readable(asked) & ~is_engine_host(url_host(asked)), asked
    )
    words = F.split(F.regexp_replace(host, r"\.translate\.goog\z", ""), "--")
    original = F.array_join(F.transform(words, lambda w: F.replace(w, F.lit("-"), F.lit("."))), "-")
    # Parameters come back sorted by name, repeats of a name in their order.
    pairs = F.filter(F.split(url_query(c), "&"), lambda p: (p != "") & ~p.startswith("_x_tr_"))
    placed = F.transform(
        pairs,
        lambda p, i: F.struct(
            F.coalesce(form_decode(F.regexp_extract(p, r"^([^=]*)", 1)), F.lit("")).alias("name"),
            i.alias("at"),
            F.coalesce(form_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)), F.lit("")).alias("value"),
        ),
    )
    encoded = F.array_join(
        F.transform(
            F.array_sort(placed),
            lambda p: F.concat(form_encode(p["name"]), F.lit("="), form_encode(p["value"])),
        ),
        "&",
    )
    tail = F.when(encoded != "", F.concat(F.lit("?"), encoded)).otherwise(F.lit(""))
    mark = F.regexp_extract(c, r"#(.+)$", 1)
    anchor = F.when(mark != "", F.concat(F.lit("#"), mark)).otherwise(F.lit(""))
    by_host = F.when(
        (original != "") & ~is_engine_host(original),
        F.concat(F.lit("https://"), original, url_path(c), tail, anchor),
    )
    return F.when(is_engine_host(host) & host.startswith("translate."), by_parameter).when(
        host.endswith(".translate.goog"), by_host
    )


def absolute_link(origin: Column | str, link: Column | str) -> Column:
    """A page's link joined to where the page came from: struct(url, error)."""
    origin, link = _col(origin), _col(link)
    whole = link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    root = F.regexp_extract(origin, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(origin, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*/)", 1)
    here = F.regexp_extract(origin, r"^([^?#]*)", 1)
    joined = (
        F.when(link.startswith("//"), F.concat(url_scheme(origin), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(here, link))
        .when(link.startswith("#"), F.concat(F.regexp_extract(origin, r"^([^#]*)", 1), link))
        .when(link == "", origin)
        .otherwise(F.concat(root, F.when(folder != "", folder).otherwise(F.lit("/")), link))
    )
    missing = F.coalesce(origin, F.lit("")) == ""
    return F.struct(
        F.when(whole, link).when(~missing, joined).alias("url"),
        F.when(~whole & missing, F.lit("no origin")).alias("error"),
    )


def search_domain(country: Column | str) -> Column:
    """The engine's domain in a country."""
    table = F.create_map(*[F.lit(x) for pair in COUNTRY_DOMAINS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(strip(country))), F.lit(DEFAULT_DOMAIN))


def search_url(text: Column | str, country: Column | str, language: Column | str, page: Column | str) -> Column:
    """The address a search is asked at; null where there is no text."""
    text, country, language = strip(text), F.lower(strip(country)), F.lower(strip(language))
    host = search_domain(country)
    start = (_col(page) - 1) * RESULTS_PER_PAGE
    asked = F.concat_ws(
        "&",
        F.when(country != "", F.concat(F.lit("gl="), form_encode(country))),
        F.when(language != "", F.concat(F.lit("hl="), form_encode(language))),
        F.concat(F.lit("q="), form_encode(text)),
        F.when(_col(page) > 1, F.concat(F.lit("start="), start.cast("string"))),
    )
    return F.when(text != "", F.concat(F.lit("https://"), host, F.lit("/search?"), asked))


def displayed_link(host: Column | str, path: Column | str, url: Column | str) -> Column:
    """The address as a page draws it under a title, '' without a host."""
    host, path = _col(host), _col(path)
    scheme = url_scheme(url)
    shown = F.concat(F.when(scheme != "", scheme).otherwise(F.lit("https")), F.lit("://"), host)
    crumbs = F.when(path != "", F.concat(F.lit(" › "), path)).otherwise(F.lit(""))
    return F.when(host != "", F.concat(shown, crumbs)).otherwise(F.lit(""))


def site_of(c: Column | str) -> Column:
    """The site a filter was typed as; a port is cut."""
    out = F.regexp_replace(F.lower(strip(c)), r"(?s)^.*?://", "")
    out = F.regexp_replace(out, r"(?s)[/?#:].*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"\.\z", ""), r"^www\.", "")


def class_in_text(c: Column | str) -> Column:
    """The response class written at the very end of a failure, else null."""
    found = F.regexp_extract(_col(c), rf"(?s)^.* \(class ({'|'.join(CLASSES)})\)\z", 1)
    return F.when(found != "", found)
