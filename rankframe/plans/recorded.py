"""Queries over the recorded history: ranks, repeats, jobs, speeds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.functions.urls import class_in_text
from rankframe.operators import history as H
from rankframe.operators import record as R
from rankframe.plans.registry import query, stamp
from rankframe.plans.views import Tables

HOST = "site7.example.com"
JOB = 3
AS_OF = "1998-06-01 00:00:00"
WINDOW = "60 days"


@query(
    "site_history",
    """SELECT r.job_id, j.name AS job_name, strftime(j.created_at, '%Y-%m-%d %H:%M:%S') AS taken_at,
         r.ordinal, q.text AS query, r.page, r.rank, r.url
       FROM h_ranked r JOIN h_queries q USING (job_id, ordinal) JOIN h_jobs j ON j.job_id = r.job_id
       WHERE r.host = 'site7.example.com' ORDER BY j.created_at, r.job_id, r.ordinal, r.rank""",
    history=True,
)
def site_history(t: Tables) -> DataFrame:
    rows = H.site_history(t.h_jobs, t.h_queries, t.h_ranked, HOST)
    return rows.withColumn("taken_at", stamp("taken_at"))


@query("cumulative_rank", "SELECT job_id, ordinal, page, position, rank FROM h_ranked", history=True)
def cumulative_rank(t: Tables) -> DataFrame:
    return R.cumulative_rank(t.h_results).select(*R.ROW, "rank")


_CANON = "regexp_replace(lower(regexp_extract(url, '^https?://([^/]*)', 1)), '^www\\.', '')"
_KEYED = f"""
keyed AS (
  SELECT r.*, j.unique_by, CASE j.unique_by
    WHEN 'url' THEN CASE WHEN url = '' THEN NULL
      ELSE {_CANON} || regexp_replace(regexp_extract(url, '^https?://[^/]*(.*)$', 1), '/$', '') END
    WHEN 'host' THEN CASE WHEN url <> '' THEN {_CANON} WHEN host <> '' THEN host ELSE NULL END
    WHEN 'text' THEN trim(title) END AS key
  FROM h_ranked r JOIN h_jobs j USING (job_id)),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, key ORDER BY ordinal, page, position) AS copy FROM keyed)
"""


def _filtered(t: Tables) -> DataFrame:
    return t.h_ranked.join(t.h_jobs.select("job_id", "unique_by"), "job_id")


@query(
    "first_seen",
    "SELECT job_id, ordinal, page, position, rank, url, host, title FROM seen WHERE key IS NULL OR copy = 1",
    history=True,
    ctes=_KEYED,
)
def first_seen(t: Tables) -> DataFrame:
    return R.first_seen(_filtered(t), "unique_by").select(*R.ROW, "rank", "url", "host", "title")


for _by, _key in (
    ("url", f"CASE WHEN url = '' THEN NULL ELSE {_CANON} || regexp_replace(regexp_extract(url, '^https?://[^/]*(.*)$', 1), '/$', '') END"),
    ("host", f"CASE WHEN url <> '' THEN {_CANON} WHEN host <> '' THEN host ELSE NULL END"),
    ("text", "trim(title)"),
):

    @query(
        f"first_seen_by_{_by}",
        f"""SELECT job_id, ordinal, page, position, rank FROM (
              SELECT *, row_number() OVER (PARTITION BY job_id, key ORDER BY ordinal, page, position) AS copy
              FROM (SELECT *, {_key} AS key FROM h_ranked))
            WHERE key IS NULL OR copy = 1""",
        history=True,
    )
    def first_seen_by(t: Tables, by: str = _by) -> DataFrame:
        return R.first_seen(t.h_ranked, F.lit(by)).select(*R.ROW, "rank")


@query(
    "first_seen_after_earlier_run",
    """SELECT job_id, ordinal, page, position FROM seen s
       WHERE ordinal % 1000 >= 100 AND (key IS NULL OR (copy_new = 1 AND NOT EXISTS (
         SELECT 1 FROM keyed e WHERE e.ordinal % 1000 < 100 AND e.job_id = s.job_id AND e.key = s.key)))""",
    history=True,
    ctes=_KEYED.replace(
        "AS copy FROM keyed",
        "AS copy_new FROM keyed WHERE ordinal % 1000 >= 100",
    ),
)
def first_seen_after_earlier_run(t: Tables) -> DataFrame:
    rows = _filtered(t)
    earlier = R.seen_keys(rows.where("ordinal % 1000 < 100"), "unique_by")
    return R.first_seen(rows.where("ordinal % 1000 >= 100"), "unique_by", earlier).select(*R.ROW)


@query(
    "dropped_counts",
    "SELECT job_id, CAST(count(*) FILTER (WHERE key IS NOT NULL AND copy > 1) AS BIGINT) AS dropped FROM seen GROUP BY job_id",
    history=True,
    ctes=_KEYED,
)
def dropped_counts(t: Tables) -> DataFrame:
    return R.dropped_counts(_filtered(t), "unique_by")


@query(
    "keep_fields",
    """SELECT job_id, ordinal, page, position, rank, CASE WHEN kind IN ('search', 'suggest') THEN title ELSE '' END AS title,
         CASE WHEN kind <> 'suggest' THEN url ELSE '' END AS url, CASE WHEN kind = 'search' THEN snippet ELSE '' END AS snippet,
         CASE WHEN kind = 'search' THEN host ELSE '' END AS host, CASE WHEN kind = 'search' THEN display_path ELSE '' END AS display_path
       FROM h_ranked JOIN h_jobs USING (job_id)""",
    history=True,
)
def keep_fields(t: Tables) -> DataFrame:
    # A search keeps everything (no choice), the other kinds one part each.
    chosen = F.when(F.col("kind") == "suggest", F.array(F.lit("title"))).when(
        F.col("kind") != "search", F.array(F.lit("url"))
    )
    rows = t.h_ranked.join(t.h_jobs.select("job_id", "kind"), "job_id")
    return R.keep_fields(rows, chosen).select(*R.ROW, "rank", "title", "url", "snippet", "host", "display_path")


@query(
    "keep_aside",
    "SELECT job_id, ordinal, page, position, title FROM h_ads JOIN h_jobs USING (job_id) WHERE kind = 'search'",
    history=True,
)
def keep_aside(t: Tables) -> DataFrame:
    chosen = F.when(F.col("kind") != "search", F.array(F.lit("title"), F.lit("related")))
    rows = t.h_ads.join(t.h_jobs.select("job_id", "kind"), "job_id")
    return R.keep_aside(rows, chosen, "ads").select(*R.ROW, "title")


@query(
    "settle_queries",
    """SELECT job_id, ordinal, CASE WHEN state <> 'pending' OR query_id % 3 = 0 THEN state
           WHEN query_id % 3 = 1 THEN 'done' ELSE 'failed' END AS state,
         CASE WHEN state = 'pending' AND query_id % 3 = 2 THEN 'dial timeout' ELSE err END AS err,
         CASE WHEN state = 'pending' AND query_id % 3 > 0 THEN '2002-01-01 00:00:00'
           ELSE strftime(settled_at, '%Y-%m-%d %H:%M:%S') END AS settled_at
       FROM h_queries""",
    history=True,
)
def settle_queries(t: Tables) -> DataFrame:
    asked = t.h_queries.where("state = 'pending' and query_id % 3 > 0")
    outcomes = asked.select(
        *R.QUERY,
        F.when(F.col("query_id") % 3 == 2, "dial timeout").alias("err"),
        F.lit("2002-01-01 00:00:00").cast("timestamp").alias("settled_at"),
    )
    settled = R.settle_queries(t.h_queries, outcomes)
    return settled.select(*R.QUERY, "state", "err", stamp("settled_at").alias("settled_at"))


def _ready_jobs(t: Tables) -> DataFrame:
    finished = F.lit("2001-08-01 00:00:00").cast("timestamp").alias("finished_at")
    return t.h_jobs.select("*", (F.col("job_id") % 5 != 0).alias("plan_ready"), finished)


@query(
    "pending",
    "SELECT job_id, ordinal, text FROM h_queries WHERE job_id = 3 AND state = 'pending' ORDER BY ordinal",
    history=True,
)
def pending(t: Tables) -> DataFrame:
    return R.pending(t.h_queries, _ready_jobs(t), JOB).select(*R.QUERY, "text")


@query(
    "retry_failed",
    """SELECT job_id, ordinal, CASE WHEN job_id = 3 AND state = 'failed' THEN 'pending' ELSE state END AS state,
         CASE WHEN job_id = 3 AND state = 'failed' THEN '' ELSE err END AS err,
         CASE WHEN job_id = 3 AND state = 'failed' THEN NULL ELSE strftime(settled_at, '%Y-%m-%d %H:%M:%S') END AS settled_at
       FROM h_queries""",
    history=True,
)
def retry_failed(t: Tables) -> DataFrame:
    again, _, _ = R.retry_failed(t.h_queries, _ready_jobs(t), JOB)
    return again.select(*R.QUERY, "state", "err", stamp("settled_at").alias("settled_at"))


@query(
    "retry_reopened_jobs",
    """SELECT j.job_id, CASE WHEN j.job_id = 3 AND EXISTS (SELECT 1 FROM h_queries q WHERE q.job_id = 3 AND q.state = 'failed')
         THEN NULL ELSE '2001-08-01 00:00:00' END AS finished_at FROM h_jobs j""",
    history=True,
)
def retry_reopened_jobs(t: Tables) -> DataFrame:
    _, jobs, _ = R.retry_failed(t.h_queries, _ready_jobs(t), JOB)
    return jobs.select("job_id", stamp("finished_at").alias("finished_at"))


@query(
    "retry_moved",
    "SELECT count(*) AS moved FROM h_queries WHERE job_id = 3 AND state = 'failed'",
    history=True,
)
def retry_moved(t: Tables) -> DataFrame:
    return R.retry_failed(t.h_queries, _ready_jobs(t), JOB)[2]


@query(
    "validate_jobs",
    """WITH forms AS (
         SELECT c_custkey AS job_id, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_name END AS name,
           CASE c_nationkey % 5 WHEN 0 THEN 'search' WHEN 1 THEN 'position' WHEN 2 THEN 'index' WHEN 3 THEN 'suggest' ELSE 'crawl' END AS kind,
           CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'url' WHEN 3 THEN 'host' WHEN 4 THEN 'text' ELSE 'sound' END AS unique_by,
           CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'example.com' END AS target,
           CAST(c_custkey % 3 AS INTEGER) AS pages, CAST(c_custkey % 5 - 1 AS INTEGER) AS suggest_limit,
           CASE c_custkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'title' WHEN 2 THEN 'url' ELSE 'all' END AS keep,
           CASE c_custkey % 13 WHEN 1 THEN 'the format has no {query}' WHEN 2 THEN 'the last number is below the first'
             WHEN 3 THEN 'the bounds are one character each' WHEN 4 THEN 'the rounds are one or more'
             WHEN 5 THEN 'the last character comes before the first' END AS format_fault
         FROM customer),
       f AS (SELECT *, CASE WHEN kind IN ('index', 'position') THEN ''
           WHEN kind = 'suggest' AND (unique_by IS NULL OR unique_by IN ('url', 'host')) THEN 'text'
           ELSE coalesce(unique_by, '') END AS filter FROM forms)
       SELECT job_id, filter, concat_ws(',',
         CASE WHEN trim(name) = '' THEN 'name missing' END,
         CASE WHEN kind = 'crawl' THEN 'kind not known' END,
         CASE WHEN unique_by = 'sound' THEN 'filter not known' END,
         CASE WHEN filter = 'text' AND kind <> 'suggest' THEN 'text filter outside suggestions' END,
         CASE WHEN kind = 'position' AND target = '' THEN 'target missing' END,
         CASE WHEN kind NOT IN ('index', 'suggest') AND pages < 1 THEN 'no page asked for' END,
         CASE WHEN kind = 'suggest' AND suggest_limit < 0 THEN 'limit below zero' END,
         CASE WHEN keep = 'none' THEN 'no field kept' END,
         CASE WHEN filter = 'url' AND keep = 'title' THEN 'filter without its address' END,
         CASE WHEN filter = 'host' AND keep IN ('title', 'url') THEN 'filter without its host' END,
         CASE WHEN kind = 'search' THEN 'format: ' || format_fault END) AS faults
       FROM f""",
)
def validate_jobs(t: Tables) -> DataFrame:
    k, m = F.col("c_custkey"), F.col("c_custkey") % 7
    kinds = F.array(*[F.lit(x) for x in ("search", "position", "index", "suggest", "crawl")])
    rules = F.array(*[F.lit(x) for x in (None, "", "url", "host", "text", "sound")])
    none = F.array().cast("array<string>")
    texts = (None, "no macro", "{query} {num:9:1}", "{abc:aa:z:1} {query}", "{query}{ABC:a:z:0}", "{abc:z:a:1}{query}", "{query} {other}")
    formats = F.array(*[F.lit(x) for x in texts])
    forms = t.customer.select(
        k.alias("job_id"),
        F.when(k % 11 == 0, "  ").otherwise(F.col("c_name")).alias("name"),
        F.get(kinds, F.col("c_nationkey") % 5).alias("kind"),
        F.get(rules, (k % 6).cast("int")).alias("unique_by"),
        F.when(k % 4 == 0, "").otherwise("example.com").alias("target"),
        (k % 3).cast("int").alias("pages"),
        (k % 5 - 1).cast("int").alias("suggest_limit"),
        F.when(m == 0, none).when(m == 1, F.array(F.lit("title"))).when(m == 2, F.array(F.lit("url"))).alias("fields"),
        F.array(F.lit(" "), F.lit("{Query} in {num:1:3}"), F.get(formats, (k % 13).cast("int"))).alias("formats"),
    )
    return R.validate_jobs(forms).select("job_id", "filter", F.array_join("faults", ",").alias("faults"))


@query(
    "counts_under",
    """SELECT job_id, 'queries' AS part, count(*) AS n FROM h_queries GROUP BY job_id
       UNION ALL SELECT job_id, 'pages', count(*) FROM h_pages GROUP BY job_id
       UNION ALL SELECT job_id, 'results', count(*) FROM h_results GROUP BY job_id
       UNION ALL SELECT job_id, 'ads', count(*) FROM h_ads GROUP BY job_id
       UNION ALL SELECT job_id, 'related', count(*) FROM h_related GROUP BY job_id
       UNION ALL SELECT job_id, 'seen', count(DISTINCT key) FROM keyed WHERE key IS NOT NULL GROUP BY job_id""",
    history=True,
    ctes=_KEYED,
)
def counts_under(t: Tables) -> DataFrame:
    parts = {"queries": t.h_queries, "pages": t.h_pages, "results": t.h_results, "ads": t.h_ads, "related": t.h_related}
    # A key is made of what was found, whatever its rank, so no ranks are recorded for this.
    found = t.h_results.join(t.h_jobs.select("job_id", "unique_by"), "job_id")
    return R.counts_under({**parts, "seen": R.seen_keys(found, "unique_by")})


@query(
    "delete_job",
    "SELECT job_id, count(*) AS results FROM h_results WHERE job_id <> 3 GROUP BY job_id",
    history=True,
)
def delete_job(t: Tables) -> DataFrame:
    return H.result_count(R.delete_job({"results": t.h_results}, JOB)["results"])


@query(
    "job_rows",
    """SELECT r.ordinal, q.text AS query, page, rank, title, url, link, host, snippet, display_path
       FROM h_ranked r JOIN h_queries q USING (job_id, ordinal) WHERE job_id = 3 ORDER BY ordinal, rank""",
    history=True,
)
def job_rows(t: Tables) -> DataFrame:
    rows = H.job_rows(t.h_queries, t.h_ranked, JOB)
    return rows.select("ordinal", "query", "page", "rank", "title", "url", "link", "host", "snippet", "display_path")


@query(
    "job_ads",
    """SELECT a.ordinal, q.text AS query, page, position, placement, title, host, url, snippet
       FROM h_ads a JOIN h_queries q USING (job_id, ordinal) WHERE job_id = 3 ORDER BY 1, 3, 4""",
    history=True,
)
def job_ads(t: Tables) -> DataFrame:
    rows = H.job_ads(t.h_queries, t.h_ads, JOB)
    return rows.select("ordinal", "query", "page", "position", "placement", "title", "host", "url", "snippet")


@query(
    "job_related",
    """SELECT r.ordinal, q.text AS query, page, position, r.query AS text
       FROM h_related r JOIN h_queries q USING (job_id, ordinal) WHERE job_id = 3 ORDER BY 1, 3, 4""",
    history=True,
)
def job_related(t: Tables) -> DataFrame:
    return H.job_related(t.h_queries, t.h_related, JOB).select("ordinal", "query", "page", "position", "text")


_ANSWERS = """
answers AS (
  SELECT q.job_id, q.ordinal, q.text, q.settled_at, count(r.rank) AS n, coalesce(min(r.rank), 0) AS rank
  FROM h_queries q LEFT JOIN h_ranked r USING (job_id, ordinal) WHERE q.state = 'done'
  GROUP BY q.job_id, q.ordinal, q.text, q.settled_at)
"""


@query("verdicts", "SELECT job_id, ordinal, text AS target, n > 0 AS held FROM answers", history=True, ctes=_ANSWERS)
def verdicts(t: Tables) -> DataFrame:
    return H.verdicts(t.h_queries, t.h_ranked).drop("settled_at")


@query(
    "standings",
    "SELECT job_id, ordinal, text AS query, rank, rank > 0 AS found FROM answers",
    history=True,
    ctes=_ANSWERS,
)
def standings(t: Tables) -> DataFrame:
    return H.standings(t.h_queries, t.h_ranked).drop("settled_at")


@query("failures", "SELECT job_id, ordinal, err FROM h_queries WHERE state = 'failed'", history=True)
def failures(t: Tables) -> DataFrame:
    return H.failures(t.h_queries)


_CLASS = "coalesce(nullif(regexp_extract(err, '.* \\(class (serp|empty|shell|wall|banned|http)\\)$', 1), ''), 'silent')"


@query(
    "class_in_text",
    f"SELECT job_id, ordinal, {_CLASS} AS class FROM h_queries",
    history=True,
)
def class_of_failures(t: Tables) -> DataFrame:
    return t.h_queries.select(*R.QUERY, F.coalesce(class_in_text("err"), F.lit("silent")).alias("class"))


@query(
    "failure_breakdown",
    f"SELECT job_id, {_CLASS} AS reason, count(*) AS n FROM h_queries WHERE state = 'failed' GROUP BY 1, 2",
    history=True,
)
def failure_breakdown(t: Tables) -> DataFrame:
    return H.failure_breakdown(t.h_queries)


_COUNTS = """
counts AS (
  SELECT job_id, count(*) AS total, count(*) FILTER (WHERE state = 'done') AS done,
    count(*) FILTER (WHERE state = 'failed') AS failed, count(*) FILTER (WHERE state = 'pending') AS pending
  FROM h_queries GROUP BY job_id)
"""


@query("progress", "SELECT * FROM counts", history=True, ctes=_COUNTS)
def progress(t: Tables) -> DataFrame:
    return H.progress(t.h_queries)


@query(
    "success_share",
    """SELECT job_id, done, failed, CASE WHEN done + failed > 0 THEN (done * 100 // (done + failed)) || '%' ELSE '—' END AS share
       FROM counts""",
    history=True,
    ctes=_COUNTS,
)
def success_share(t: Tables) -> DataFrame:
    return H.success_share(t.h_queries)


@query(
    "job_summaries",
    """SELECT j.job_id, name, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, kind, coalesce(total, 0) AS total,
         coalesce(done, 0) AS done, coalesce(failed, 0) AS failed, coalesce(pending, 0) AS pending
       FROM h_jobs j LEFT JOIN counts c ON c.job_id = j.job_id ORDER BY j.created_at DESC, j.job_id DESC LIMIT 10""",
    history=True,
    ctes=_COUNTS,
)
def job_summaries(t: Tables) -> DataFrame:
    return H.job_summaries(t.h_jobs, t.h_queries, 10).withColumn("created_at", stamp("created_at"))


@query("result_count", "SELECT job_id, count(*) AS results FROM h_results GROUP BY job_id", history=True)
def result_count(t: Tables) -> DataFrame:
    return H.result_count(t.h_results)


@query(
    "latest_rows",
    """SELECT r.ordinal, q.text AS query, page, rank, title, url FROM h_ranked r JOIN h_queries q USING (job_id, ordinal)
       WHERE job_id = 3 ORDER BY q.settled_at DESC NULLS LAST, r.ordinal DESC, rank DESC LIMIT 25""",
    history=True,
)
def latest_rows(t: Tables) -> DataFrame:
    rows = H.latest_rows(t.h_queries, t.h_ranked, JOB, 25)
    return rows.select("ordinal", "query", "page", "rank", "title", "url")


@query(
    "latest_verdicts",
    """SELECT ordinal, text AS target, n > 0 AS held FROM answers WHERE job_id = 3
       ORDER BY settled_at DESC NULLS LAST, ordinal DESC LIMIT 20""",
    history=True,
    ctes=_ANSWERS,
)
def latest_verdicts(t: Tables) -> DataFrame:
    return H.latest_verdicts(t.h_queries, t.h_ranked, JOB, 20).select("ordinal", "target", "held")


@query(
    "latest_standings",
    """SELECT ordinal, text AS query, rank, rank > 0 AS found FROM answers WHERE job_id = 3
       ORDER BY settled_at DESC NULLS LAST, ordinal DESC LIMIT 20""",
    history=True,
    ctes=_ANSWERS,
)
def latest_standings(t: Tables) -> DataFrame:
    return H.latest_standings(t.h_queries, t.h_ranked, JOB, 20).select("ordinal", "query", "rank", "found")


_PACE = """
took AS (SELECT job_id, ordinal, count(*) AS pages FROM h_pages GROUP BY 1, 2),
moments AS (
  SELECT q.job_id, q.ordinal, q.settled_at, coalesce(pages, 0) AS pages,
    row_number() OVER (PARTITION BY q.job_id ORDER BY q.settled_at, q.ordinal) AS place
  FROM h_queries q LEFT JOIN took t ON t.job_id = q.job_id AND t.ordinal = q.ordinal
  WHERE q.settled_at >= TIMESTAMP '1998-06-01 00:00:00' - INTERVAL 60 DAY),
speed AS (
  SELECT job_id, count(*) - 1 AS settled, CAST(coalesce(sum(pages) FILTER (WHERE place > 1), 0) AS BIGINT) AS pages,
    epoch(max(settled_at)) - epoch(min(settled_at)) AS over_seconds, count(*) >= 2 AND max(settled_at) > min(settled_at) AS known
  FROM moments GROUP BY job_id)
"""


@query(
    "pace",
    """SELECT job_id, known, CASE WHEN known THEN settled ELSE 0 END AS settled, CASE WHEN known THEN pages ELSE 0 END AS pages,
         round(CASE WHEN known THEN settled * 60 / over_seconds ELSE 0 END, 6) AS per_minute,
         round(CASE WHEN known THEN pages * 60 / over_seconds ELSE 0 END, 6) AS pages_per_minute FROM speed""",
    history=True,
    ctes=_PACE,
)
def pace(t: Tables) -> DataFrame:
    rows = H.pace(t.h_queries, t.h_pages, F.lit(AS_OF).cast("timestamp"), WINDOW)
    return rows.select(
        "job_id", "known", "settled", "pages", F.round("per_minute", 6).alias("per_minute"),
        F.round("pages_per_minute", 6).alias("pages_per_minute"),
    )


@query(
    "remaining",
    """SELECT j.job_id, coalesce(c.pending, 0) AS pending,
         round(CASE WHEN known AND c.pending > 0 THEN c.pending * 60 / (settled * 60 / over_seconds) END, 3) AS remaining_seconds,
         round(epoch(TIMESTAMP '1998-06-01 00:00:00') - epoch(created_at), 3) AS elapsed_seconds
       FROM h_jobs j LEFT JOIN counts c ON c.job_id = j.job_id LEFT JOIN fast s ON s.job_id = j.job_id""",
    history=True,
    ctes=_COUNTS + "," + _PACE + ", fast AS (SELECT * FROM speed)",
)
def remaining(t: Tables) -> DataFrame:
    # The window is the library's five minutes stretched to the fixture's days.
    as_of = F.lit(AS_OF).cast("timestamp")
    rows = H.remaining(t.h_jobs, t.h_queries, t.h_pages, as_of, WINDOW)
    return rows.select(
        "job_id", "pending", F.round("remaining_seconds", 3).alias("remaining_seconds"),
        F.round("elapsed_seconds", 3).alias("elapsed_seconds"),
    )
