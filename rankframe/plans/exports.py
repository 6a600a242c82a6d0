"""Queries that shape rows into files: layouts, JSON lines, documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.operators import history as H
from rankframe.operators import layouts as Y
from rankframe.operators import pages as P
from rankframe.plans.pages import PAGE, rendered
from rankframe.plans.recorded import HOST, JOB
from rankframe.plans.registry import query
from rankframe.plans.views import Tables
from rankframe.sources.writers import layout_lines

_ROWS = "FROM h_ranked r JOIN h_queries q USING (job_id, ordinal)"
RESULT_ORDER = ["ordinal", "rank"]


def _rows(t: Tables) -> DataFrame:
    texts = t.h_queries.select("job_id", "ordinal", F.col("text").alias("query"))
    return t.h_ranked.join(texts, ["job_id", "ordinal"])


@query(
    "export_csv",
    f"""SELECT job_id, ordinal, rank, '"' || title || ', ""' || page || '"" ' || chr(10) || 'x",' || rank || ',' || url || ','
         || CASE WHEN snippet LIKE 'snippet 1%' THEN '" ' || snippet || '"' ELSE snippet END AS line {_ROWS}""",
    history=True,
)
def export_csv(t: Tables) -> DataFrame:
    odd = F.concat("title", F.lit(', "'), "page", F.lit('" \nx'))
    padded = F.when(F.col("snippet").startswith("snippet 1"), F.concat(F.lit(" "), "snippet")).otherwise(F.col("snippet"))
    rows = _rows(t).withColumns({"title": odd, "snippet": padded})
    layout = Y.Layout("results", ("title", "rank", "url", "snippet"))
    return rows.select("job_id", *RESULT_ORDER, Y.csv_line(layout).alias("line"))


@query(
    "export_txt",
    f"SELECT job_id, ordinal, rank, host || ';' || title || ' ' || page || '  x;' || rank AS line {_ROWS}",
    history=True,
)
def export_txt(t: Tables) -> DataFrame:
    rows = _rows(t).withColumn("title", F.concat("title", F.lit(";"), "page", F.lit("\r\nx")))
    layout = Y.Layout("results", ("host", "title", "rank"), format=Y.TXT, sep=Y.separator(";"))
    return rows.select("job_id", *RESULT_ORDER, Y.text_line(layout).alias("line"))


@query(
    "export_jsonl",
    f"""SELECT job_id, ordinal, rank, '{{"suggestion":"' || title || '","key":"' || q.text || '","related":' || CASE WHEN offtopic THEN 'false' ELSE 'true' END
         || ',"similarity":' || CASE WHEN similarity IS NULL THEN 'null' WHEN similarity >= 0.5 THEN '1' WHEN ordinal % 3 = 0 THEN '0.0005' WHEN ordinal % 3 = 1 THEN '0' ELSE '-0.25' END || ',"ordinal":' || ordinal || '}}' AS line {_ROWS}""",
    history=True,
)
def export_jsonl(t: Tables) -> DataFrame:
    k = F.col("ordinal") % 3
    level = F.when(F.col("similarity").isNotNull(), F.when(F.col("similarity") >= 0.5, 1.0).when(k == 0, 0.0005).when(k == 1, 0.0).otherwise(-0.25))
    layout = Y.Layout("completions", ("suggestion", "key", "related", "similarity", "ordinal"), format=Y.JSONL)
    return _rows(t).withColumn("similarity", level).select("job_id", *RESULT_ORDER, Y.json_line(layout).alias("line"))


@query(
    "export_verdicts",
    """SELECT ordinal, '{"ordinal":' || ordinal || ',"target":"' || text || '","held":' || CASE WHEN n > 0 THEN 'true' ELSE 'false' END || '}' AS line
       FROM (SELECT q.job_id, q.ordinal, q.text, count(r.page) AS n FROM h_queries q LEFT JOIN h_results r USING (job_id, ordinal)
         WHERE state = 'done' GROUP BY 1, 2, 3)""",
    history=True,
)
def export_verdicts(t: Tables) -> DataFrame:
    layout = Y.Layout("verdicts", format=Y.JSONL)
    return H.verdicts(t.h_queries, t.h_results).select("ordinal", Y.json_line(layout).alias("line"))


@query(
    "project_layout",
    f"""SELECT CAST(ordinal AS VARCHAR) AS ordinal, CASE WHEN offtopic THEN 'false' ELSE 'true' END AS related,
         CASE WHEN similarity IS NULL THEN '' ELSE printf('%.3f', similarity) END AS similarity, title AS suggestion {_ROWS}""",
    history=True,
)
def project_layout(t: Tables) -> DataFrame:
    return Y.project_layout(_rows(t), Y.Layout("completions", ("similarity", "related", "suggestion", "ordinal")))


@query(
    "distinct_layout",
    f"""SELECT ordinal, rank, host, title FROM (
         SELECT *, row_number() OVER (PARTITION BY host, title ORDER BY ordinal, rank) AS copy FROM h_ranked)
       WHERE copy = 1""",
    history=True,
)
def distinct_layout(t: Tables) -> DataFrame:
    layout = Y.Layout("results", ("title", "host"))
    return Y.distinct_layout(t.h_ranked, layout, RESULT_ORDER).select("ordinal", "rank", "host", "title")


@query(
    "export_lines",
    f"""SELECT line FROM (SELECT 'host,title' AS line UNION ALL
         SELECT host || ',' || title FROM (
           SELECT *, row_number() OVER (PARTITION BY host, title ORDER BY ordinal, rank) AS copy FROM h_ranked WHERE job_id = 3)
         WHERE copy = 1)""",
    history=True,
)
def export_lines(t: Tables) -> DataFrame:
    """A whole file as lines: header first, repeats of the chosen columns out."""
    rows = t.h_ranked.where(F.col("job_id") == JOB)
    return layout_lines(rows, Y.Layout("results", ("host", "title"), unique=True), RESULT_ORDER).select("line")


@query(
    "preview",
    f"""SELECT ordinal, rank, host FROM (
         SELECT *, row_number() OVER (PARTITION BY host ORDER BY ordinal, rank) AS copy FROM (
           SELECT * FROM h_ranked WHERE job_id = 3 ORDER BY ordinal, rank LIMIT 10000)) WHERE copy = 1 ORDER BY ordinal, rank LIMIT 10""",
    history=True,
)
def preview(t: Tables) -> DataFrame:
    layout = Y.Layout("results", ("host",), unique=True)
    return Y.preview(t.h_ranked.where(F.col("job_id") == JOB), layout, RESULT_ORDER).select("ordinal", "rank", "host")


@query(
    "results_ndjson",
    f"""SELECT job_id, ordinal, rank, '{{"ordinal":' || ordinal || ',"query":"' || q.text || '","page":' || page || ',"rank":' || rank || ',"title":"' || title
         || '","url":"' || url || '","host":"' || host || '","snippet":"' || snippet || '"}}' AS line {_ROWS} WHERE job_id = 3""",
    history=True,
)
def results_ndjson(t: Tables) -> DataFrame:
    lines = Y.results_ndjson(H.job_rows(t.h_queries, t.h_ranked, JOB))
    return lines.select(F.lit(JOB).cast("long").alias("job_id"), "ordinal", "rank", "line")


@query(
    "history_ndjson",
    """SELECT r.job_id, r.ordinal, rank, '{"job_id":' || r.job_id || ',"job_name":"' || j.name || '","taken_at":"' || strftime(j.created_at, '%Y-%m-%dT%H:%M:%SZ')
         || '","query":"' || q.text || '","rank":' || rank || ',"url":"' || url || '"}' AS line
       FROM h_ranked r JOIN h_queries q USING (job_id, ordinal) JOIN h_jobs j ON j.job_id = r.job_id WHERE host = 'site7.example.com'""",
    history=True,
)
def history_ndjson(t: Tables) -> DataFrame:
    return Y.history_ndjson(H.site_history(t.h_jobs, t.h_queries, t.h_ranked, HOST))


# Countries by number, and the domain a search of each is asked at.
_COUNTRY = "CASE ordinal % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'uk' WHEN 2 THEN 'zz' ELSE '' END"
_DOMAIN = "CASE ordinal % 4 WHEN 0 THEN 'google.de' WHEN 1 THEN 'google.co.uk' ELSE 'google.com' END"


@query(
    "serp_documents",
    f"""SELECT job_id, ordinal, page, count(*) FILTER (WHERE copy = 1) AS results, string_agg(CASE WHEN url <> '' THEN url ELSE 'https://www.' || domain || link END, ' ' ORDER BY position) FILTER (WHERE copy = 1) AS links,
         string_agg(CASE WHEN host = '' AND url = '' THEN '' ELSE CASE WHEN url LIKE 'http://%' THEN 'http' ELSE 'https' END || '://' ||
           CASE WHEN host <> '' THEN host || ' › ' || display_path ELSE lower(regexp_extract(url, '^https?://([^/]*)', 1)) END END, ' ' ORDER BY position) FILTER (WHERE copy = 1) AS shown,
         '{{"engine":"google","q":"query ' || ordinal || '","google_domain":"' || any_value(google_domain) || '"' ||
           CASE WHEN any_value(country) <> '' THEN ',"gl":"' || any_value(country) || '"' ELSE '' END || ',"hl":"en","device":"desktop"}}' AS asked,
         string_agg(DISTINCT CASE WHEN quantity >= 40 THEN 'more ' || quantity || '|https://www.' || google_domain || '/search?' ||
           CASE WHEN country <> '' THEN 'gl=' || country || '&' ELSE '' END || 'hl=en&q=more+' || quantity END, ' ' ORDER BY CASE WHEN quantity >= 40 THEN 'more ' || quantity || '|https://www.' || google_domain || '/search?' ||
           CASE WHEN country <> '' THEN 'gl=' || country || '&' ELSE '' END || 'hl=en&q=more+' || quantity END) AS more,
         any_value(n_ads) AS ads
       FROM (SELECT *, row_number() OVER (PARTITION BY job_id, ordinal, page, CASE WHEN url <> '' THEN url ELSE link END ORDER BY position) AS copy,
           {_COUNTRY} AS country, {_DOMAIN} AS google_domain,
           CASE WHEN page % 2 = 0 THEN {_DOMAIN} ELSE 'google.fr' END AS domain,
           1 + count(*) FILTER (WHERE quantity <= 4) OVER (PARTITION BY job_id, ordinal, page) AS n_ads FROM h_results)
       WHERE copy = 1 OR quantity >= 40 GROUP BY 1, 2, 3""",
    history=True,
)
def serp_documents(t: Tables) -> DataFrame:
    """The documents, read back whole; every second page does not know its origin."""
    k = F.col("ordinal") % 4
    country = F.when(k == 0, "de").when(k == 1, "uk").when(k == 2, "zz").otherwise("")
    origin = F.when(F.col("page") % 2 == 0, "").otherwise("https://www.google.fr")
    asked = rendered(t).withColumns(
        {"query": F.concat(F.lit("query "), "ordinal"), "country": country, "language": F.lit("en"), "origin": origin}
    )
    documents = Y.serp_documents(P.extract_serps(asked))
    shape = """struct<organic_results:array<struct<link:string,displayed_link:string>>,ads_omitted:int,
        related_searches:array<struct<query:string,link:string>>>"""
    read = documents.withColumn("d", F.from_json("document", shape))
    organic, more = F.col("d.organic_results"), F.col("d.related_searches")
    return read.select(
        *PAGE, F.size(organic).cast("long").alias("results"), F.array_join(organic["link"], " ").alias("links"),
        F.array_join(organic["displayed_link"], " ").alias("shown"),
        F.regexp_extract("document", r'^\{"search_parameters":(\{[^}]*\})', 1).alias("asked"),
        F.array_join(F.array_sort(F.transform(more, lambda m: F.concat(m["query"], F.lit("|"), m["link"]))), " ").alias("more"),
        F.col("d.ads_omitted").cast("long").alias("ads"),
    )
