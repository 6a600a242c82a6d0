"""Queries over addresses: canonical forms, link forms, search links."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.functions import urls as U
from rankframe.plans.registry import query
from rankframe.plans.views import Tables

# The plain reading of the pages' addresses, all of them http(s) with a host.
_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), '^www\\.', '')"
_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
_QUERY = "regexp_extract(url, '\\?([^#]*)', 1)"
_CANONICAL = (
    f"{_HOST} || regexp_replace({_PATH}, '/$', '') || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END"
)


@query("normalise_site", f"SELECT page_id, {_HOST} AS site FROM pages")
def normalise_site(t: Tables) -> DataFrame:
    # Padded, upper-case and with the dot a full host name may end in.
    typed = F.concat(F.lit("  "), F.upper("url"), F.lit(" "))
    dotted = F.concat(F.upper(U.url_host("url")), F.lit("."))
    asked = F.when(F.col("page_id") % 2 == 0, typed).otherwise(dotted)
    return t.pages.select("page_id", U.normalise_site(asked).alias("site"))


@query("canonical_url", f"SELECT page_id, {_CANONICAL} AS canonical FROM pages")
def canonical_url(t: Tables) -> DataFrame:
    # The same address with user, port, fragment and www must come out alike.
    dressed = F.regexp_replace(F.concat(F.lit(" "), "url"), "://(www\\.)?", "://me:pw@www.")
    dressed = F.concat(F.regexp_replace(F.regexp_replace(dressed, "#.*$", ""), "^(.*?://[^/]*)/", "$1:8080/"), F.lit("#f "))
    asked = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(dressed)
    return t.pages.select("page_id", U.canonical_url(asked).alias("canonical"))


@query("canonical_host", f"SELECT page_id, {_HOST} AS host FROM pages")
def canonical_host(t: Tables) -> DataFrame:
    asked = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(U.url_host("url"))
    return t.pages.select("page_id", U.canonical_host(asked).alias("host"))


@query(
    "same_url",
    f"""WITH c AS (SELECT page_id, {_CANONICAL} AS canonical FROM pages)
        SELECT canonical, count(*) AS copies FROM c GROUP BY canonical""",
)
def same_url(t: Tables) -> DataFrame:
    """Pages that are one address, counted by equality of the canonical form."""
    plain = F.regexp_replace("url", "^https?", "http")
    same = t.pages.where(U.same_url("url", plain))
    return same.groupBy(U.canonical_url("url").alias("canonical")).agg(F.count(F.lit(1)).alias("copies"))


@query(
    "split_site",
    f"""SELECT page_id, {_HOST} AS want_host,
          CASE WHEN trim({_PATH}, '/') <> '' THEN url ELSE '' END AS want_url FROM pages""",
)
def split_site(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.split_site("url").alias("w")).select("page_id", "w.want_host", "w.want_url")


@query(
    "host_belongs_to",
    f"""SELECT page_id, {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' AS belongs,
          {_HOST} = 'ample.com' OR {_HOST} LIKE '%.ample.com' AS lookalike FROM pages""",
)
def host_belongs_to(t: Tables) -> DataFrame:
    def below(site: str) -> Column:
        return U.host_belongs_to(U.url_host("url"), F.lit(site))

    return t.pages.select("page_id", below("example.com").alias("belongs"), below("ample.com").alias("lookalike"))


@query(
    "site_query",
    f"SELECT page_id, 'site:' || {_HOST} || regexp_replace({_PATH}, '/+$', '') AS question FROM pages",
)
def site_query(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.site_query("url").alias("question"))


@query(
    "is_engine_host",
    f"""WITH h AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN {_HOST} WHEN 1 THEN 'www.google.com.' WHEN 2 THEN 'google.co.uk'
            WHEN 3 THEN 'google.' || {_HOST} WHEN 4 THEN 'GOOGLE.de' ELSE 'google.myshop.com' END AS host FROM pages)
        SELECT page_id, page_id % 6 IN (1, 2, 4) AS own FROM h""",
)
def is_engine_host(t: Tables) -> DataFrame:
    k = F.col("page_id") % 6
    host = (
        F.when(k == 0, U.url_host("url")).when(k == 1, "www.google.com.").when(k == 2, "google.co.uk")
        .when(k == 3, F.concat(F.lit("google."), U.url_host("url"))).when(k == 4, "GOOGLE.de")
        .otherwise("google.myshop.com")
    )
    return t.pages.select("page_id", U.is_engine_host(host).alias("own"))


@query(
    "classify_link",
    """SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url ELSE '' END AS dest,
         CASE page_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'redirect' WHEN 2 THEN 'encrypted' ELSE '' END AS form,
         page_id % 5 < 3 AS ok FROM pages""",
)
def classify_link(t: Tables) -> DataFrame:
    k, coded = F.col("page_id") % 5, U.form_encode(F.col("url"))
    href = (
        F.when(k == 0, F.col("url"))
        .when(k == 1, F.concat(F.lit("/url?sa=t&q=https%3A%2F%2Fwww.google.com%2F&url="), coded, F.lit("&ved=1")))
        .when(k == 2, F.concat(F.lit("/goto?url="), coded))
        .when(k == 3, F.concat(F.lit("https://www.google.de/url?q="), coded))
        .otherwise(F.concat(F.lit("/search?q="), coded))
    )
    return t.pages.select("page_id", U.classify_link(href).alias("l")).select("page_id", "l.dest", "l.form", "l.ok")


@query(
    "untranslated",
    f"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN url
          WHEN 1 THEN 'https://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) || {_PATH} || '?a=1&b=2' END AS page FROM pages""",
)
def untranslated(t: Tables) -> DataFrame:
    k, coded = F.col("page_id") % 3, U.form_encode(F.col("url"))
    folded = F.regexp_replace(F.regexp_replace(F.lower(U.url_host("url")), "-", "--"), "\\.", "-")
    link = (
        F.when(k == 0, F.concat(F.lit("https://translate.google.com/translate?hl=en&u="), coded))
        .when(k == 1, F.concat(F.lit("https://"), folded, F.lit(".translate.goog"), U.url_path("url"),
                               F.lit("?b=2&_x_tr_sl=fr&a=1&_x_tr_tl=en")))
        .otherwise(F.col("url"))
    )
    return t.pages.select("page_id", U.untranslated(link).alias("page"))


@query(
    "absolute_link",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 3 THEN NULL
         ELSE 'https://www.google.de/goto?u=' || page_id END AS link, CASE WHEN page_id % 4 = 3 THEN 'no origin' END AS error
       FROM pages""",
)
def absolute_link(t: Tables) -> DataFrame:
    k = F.col("page_id") % 4
    origin = F.when(k == 3, "").otherwise("https://www.google.de/search?q=x")
    goto = F.concat(F.lit("goto?u="), "page_id")
    link = F.when(k == 0, F.col("url")).when(k == 1, goto).otherwise(F.concat(F.lit("/"), goto))
    joined = U.absolute_link(origin, link)
    return t.pages.select("page_id", joined.alias("j")).select("page_id", F.col("j.url").alias("link"), "j.error")


@query(
    "search_url",
    """SELECT p_partkey, 'https://' || CASE p_partkey % 4 WHEN 0 THEN 'www.google.de' WHEN 1 THEN 'www.google.co.uk' ELSE 'www.google.com' END
         || '/search?' || CASE p_partkey % 4 WHEN 0 THEN 'gl=de&hl=en&' WHEN 1 THEN 'gl=uk&hl=en&' WHEN 2 THEN 'gl=zz&hl=en&' ELSE 'hl=en&' END
         || 'q=' || replace(p_name, ' ', '+') || '%26' || CASE WHEN p_size % 3 > 0 THEN '&start=' || (p_size % 3 * 10) ELSE '' END AS url
       FROM part""",
)
def search_url(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 4
    country = F.when(k == 0, " DE").when(k == 1, "uk").when(k == 2, "zz").otherwise("")
    text = F.concat(F.lit(" "), "p_name", F.lit("& "))
    page = F.col("p_size") % 3 + 1
    return t.part.select("p_partkey", U.search_url(text, country, F.lit("EN"), page).alias("url"))


@query(
    "displayed_link",
    """SELECT job_id, ordinal, page, position, CASE WHEN host = '' THEN '' ELSE
         CASE WHEN url LIKE 'http://%' THEN 'http' ELSE 'https' END || '://' || host || ' › ' || display_path END AS shown
       FROM h_results""",
    history=True,
)
def displayed_link(t: Tables) -> DataFrame:
    shown = U.displayed_link("host", "display_path", "url")
    return t.h_results.select("job_id", "ordinal", "page", "position", shown.alias("shown"))


@query("site_of", f"SELECT page_id, {_HOST} AS site FROM pages")
def site_of(t: Tables) -> DataFrame:
    typed = F.concat(F.lit(" "), F.upper(U.url_host("url")), F.lit(".:8080/x "))
    dotted = F.concat(F.upper(U.url_host("url")), F.lit(". "))
    asked = F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, dotted)
    asked = asked.otherwise(F.regexp_replace(typed, r"\.:", ":"))
    return t.pages.select("page_id", U.site_of(asked).alias("site"))
