"""Queries that ask where a site stands and what of it is held."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.functions import urls as U
from rankframe.operators import record as R
from rankframe.operators import sites as S
from rankframe.plans.registry import query
from rankframe.plans.views import Tables

# An address as compared: host without www, path without its last slash.
_C = (
    "regexp_replace(lower(regexp_extract({0}, '^https?://([^/]*)', 1)), '^www\\.', '')"
    " || regexp_replace(regexp_extract({0}, '^https?://[^/]*(.*)$', 1), '/$', '')"
)
_MATCH = f"""CASE WHEN site LIKE '%/p/%' THEN r.url <> '' AND {_C.format('r.url')} = {_C.format('site')}
  ELSE r.host <> '' AND (r.host = site OR r.host LIKE '%.' || site) END"""


@query(
    "walk_extent",
    """SELECT job_id, ordinal, page FROM (
         SELECT *, count(*) OVER w AS place, coalesce(count(*) FILTER (WHERE n_results = 0 OR last) OVER
             (PARTITION BY job_id, ordinal ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended
         FROM walk WINDOW w AS (PARTITION BY job_id, ordinal ORDER BY page))
       WHERE place = page AND ended = 0 AND n_results > 0""",
    history=True,
    ctes="""walk AS (
      SELECT job_id, ordinal, page, CASE WHEN bool_or(quantity = 50) THEN 0 ELSE count(*) END AS n_results,
        bool_or(quantity = 7) AND min(position) * 4 <= (page - 1) * 10 AS last
      FROM h_results WHERE NOT (page = 2 AND ordinal % 7 = 0) GROUP BY 1, 2, 3)""",
)
def walk_extent(t: Tables) -> DataFrame:
    rows = t.h_results.where(~((F.col("page") == 2) & (F.col("ordinal") % 7 == 0)))
    pages = rows.groupBy(*R.QUERY, "page").agg(
        F.when(F.bool_or(F.col("quantity") == 50), 0).otherwise(F.count(F.lit(1))).alias("n_results"),
        F.bool_or(F.col("quantity") == 7).alias("has_pagination"),
        (F.min("position") * 4).alias("max_offset"),
    )
    return S.walk_extent(pages).select(*R.QUERY, "page")


@query(
    "find_positions",
    f"""WITH_MATCH
       SELECT q.job_id, q.ordinal, q.text AS query, j.site, f.rank IS NOT NULL AS found, coalesce(f.rank, 0) AS rank,
         coalesce(f.page, 0) AS page, CASE WHEN f.rank IS NULL THEN 'none' WHEN j.site LIKE '%/p/%' THEN 'url' ELSE 'host' END AS how,
         coalesce(f.rank, read.n, 0) AS scanned
       FROM h_queries q JOIN h_jobs j USING (job_id)
       LEFT JOIN first f ON f.job_id = q.job_id AND f.ordinal = q.ordinal
       LEFT JOIN (SELECT job_id, ordinal, count(*) AS n FROM counted GROUP BY 1, 2) read
         ON read.job_id = q.job_id AND read.ordinal = q.ordinal""".replace("WITH_MATCH\n", ""),
    history=True,
    ctes=f"""shown AS (SELECT *, ordinal % 3 = 0 AND page >= 2 AS over FROM h_results),
    counted AS (
      SELECT *, row_number() OVER (PARTITION BY job_id, ordinal ORDER BY page, position) AS rank FROM shown WHERE NOT over),
    first AS (
      SELECT r.job_id, r.ordinal, min(rank) AS rank, arg_min(page, rank) AS page
      FROM counted r JOIN h_jobs j USING (job_id) WHERE {_MATCH} GROUP BY 1, 2)""",
)
def find_positions(t: Tables) -> DataFrame:
    """The walk of every third query ends with its first page, by that page's bar."""
    pages = t.h_results.groupBy(*R.QUERY, "page").agg(F.count(F.lit(1)).alias("n_results")).withColumns(
        {"has_pagination": F.col("ordinal") % 3 == 0, "max_offset": F.lit(0)}
    )
    return S.find_positions(t.h_queries, t.h_results, t.h_jobs.select("job_id", "site"), pages)


def _targets(t: Tables) -> DataFrame:
    return t.h_queries.select(*R.QUERY, "job_id").join(t.h_jobs.select("job_id", "site"), "job_id").select(*R.QUERY, "site")


@query(
    "index_verdicts",
    """SELECT q.job_id, q.ordinal, site AS target, coalesce(hits, 0) > 0 AS indexed, coalesce(hits, 0) AS hits,
         coalesce(sample, '') AS sample
       FROM h_queries q JOIN h_jobs j USING (job_id)
       JOIN h_pages p ON p.job_id = q.job_id AND p.ordinal = q.ordinal AND p.page = 1
       LEFT JOIN told ON told.job_id = q.job_id AND told.ordinal = q.ordinal""",
    history=True,
    ctes=f"""hit AS (
      SELECT r.*, row_number() OVER (PARTITION BY r.job_id, r.ordinal ORDER BY position) AS place
      FROM h_results r JOIN h_jobs j USING (job_id) WHERE page = 1 AND {_MATCH}),
    told AS (SELECT job_id, ordinal, count(*) AS hits, string_agg(title, '|' ORDER BY position) FILTER (WHERE place <= 3) AS sample
      FROM hit GROUP BY 1, 2)""",
)
def index_verdicts(t: Tables) -> DataFrame:
    rows = S.index_verdicts(t.h_pages, t.h_results, _targets(t))
    return rows.withColumn("sample", F.array_join("sample", "|"))


@query(
    "index_unread",
    """SELECT r.job_id, r.ordinal, page, position FROM h_results r JOIN h_jobs j USING (job_id)
       WHERE url = '' AND link <> '' AND site LIKE '%/p/%'
         AND (host = '' OR host = regexp_replace(regexp_extract(site, '^https?://([^/]*)', 1), '^www\\.', ''))""",
    history=True,
)
def index_unread(t: Tables) -> DataFrame:
    return S.index_unread(t.h_results, _targets(t)).select(*R.ROW)


@query(
    "list_indexed",
    """SELECT job_id, ordinal, page, position, link FROM (
         SELECT r.*, row_number() OVER (PARTITION BY r.job_id, r.ordinal, link ORDER BY page, position) AS copy
         FROM h_results r JOIN h_jobs j USING (job_id)
         WHERE host = 'site' || (job_id % 4) || '.example.com' OR (job_id % 2 = 0 AND host LIKE '%.example.com'))
       WHERE copy = 1""",
    history=True,
)
def list_indexed(t: Tables) -> DataFrame:
    site = F.when(F.col("job_id") % 2 == 0, "example.com").otherwise(
        F.concat(F.lit("site"), F.col("job_id") % 4, F.lit(".example.com"))
    )
    sites = t.h_queries.select(*R.QUERY, site.alias("site"))
    return S.list_indexed(t.h_results, sites).select(*R.ROW, "link")


@query(
    "only_site",
    """SELECT job_id, ordinal, page, position FROM h_results
       WHERE CASE WHEN host <> '' THEN host ELSE lower(regexp_extract(url, '^https?://([^/]*)', 1)) END = 'site7.example.com'""",
    history=True,
)
def only_site(t: Tables) -> DataFrame:
    return S.only_site(t.h_results, " https://www.Site7.example.com:443/x ").select(*R.ROW)


_LOOKUPS = """
lookups AS (
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN 200 ELSE 302 END AS status,
    CASE p_partkey % 4 WHEN 0 THEN 'https://shop.example.org/' || p_partkey WHEN 1 THEN 'https://www.google.com/sorry?q=' || p_partkey
      WHEN 2 THEN 'https://shop-example-org.translate.goog/t/' || p_partkey || '?_x_tr_sl=en' ELSE '' END AS location
  FROM part WHERE p_partkey % 10 > 0),
looked AS (
  SELECT r.*, CASE WHEN r.url <> '' OR link = '' THEN ''
      WHEN link NOT LIKE '/goto%' OR k.status IS NULL THEN 'untried'
      WHEN k.status = 302 AND k.p_partkey % 4 IN (0, 2) THEN 'resolved' ELSE 'failed' END AS resolution,
    CASE WHEN r.url <> '' THEN r.url WHEN k.p_partkey % 4 = 0 THEN k.location
      WHEN k.p_partkey % 4 = 2 THEN 'https://shop.example.org/t/' || k.p_partkey ELSE '' END AS found
  FROM h_results r LEFT JOIN lookups k ON r.url = '' AND link = '/goto?u=' || k.p_partkey)
"""


def _resolved(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    location = (
        F.when(k % 4 == 0, F.concat(F.lit("https://shop.example.org/"), k))
        .when(k % 4 == 1, F.concat(F.lit("https://www.google.com/sorry?q="), k))
        .when(k % 4 == 2, F.concat(F.lit("https://shop-example-org.translate.goog/t/"), k, F.lit("?_x_tr_sl=en")))
        .otherwise("")
    )
    lookups = t.part.where(k % 10 > 0).select(
        F.concat(F.lit("https://www.google.de/goto?u="), k).alias("link"),
        F.when(k % 4 == 3, 200).otherwise(302).alias("status"),
        location.alias("location"),
    )
    rows = t.h_results.withColumn("origin", F.lit("https://www.google.de"))
    return S.resolve_from_lookup(rows, lookups)


@query(
    "resolve_from_lookup",
    "SELECT job_id, ordinal, page, position, found AS url, resolution FROM looked",
    history=True,
    ctes=_LOOKUPS,
)
def resolve_from_lookup(t: Tables) -> DataFrame:
    return _resolved(t).select(*R.ROW, "url", "resolution")


@query(
    "resolve_report",
    """SELECT job_id, count(*) FILTER (WHERE resolution <> '') AS attempted, count(*) FILTER (WHERE resolution = 'resolved') AS resolved,
         count(*) FILTER (WHERE resolution = 'failed') AS failed FROM looked GROUP BY job_id""",
    history=True,
    ctes=_LOOKUPS,
)
def resolve_report(t: Tables) -> DataFrame:
    return S.resolve_report(_resolved(t), ["job_id"])


@query(
    "host_tree",
    f"""WITH h AS (SELECT string_split({_C.format('url').split(' || ')[0]}, '.') AS labels FROM pages)
        SELECT array_to_string(labels[i:], '.') AS site, count(*) AS pages
        FROM (SELECT labels, unnest(range(1, len(labels) + 1)) AS i FROM h) GROUP BY 1""",
)
def host_tree(t: Tables) -> DataFrame:
    """Pages under every domain: what a site question is matched against."""
    sites = t.pages.select(F.explode(U.host_suffixes(U.url_host("url"))).alias("site"))
    return sites.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
