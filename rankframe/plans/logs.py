"""Queries over the event log: rhythm, census, tallies, speeds, streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.operators import history as H
from rankframe.operators import logs as L
from rankframe.plans.registry import query
from rankframe.plans.views import Tables

CENSUS_AT = "2024-01-15 00:00:00"


def session_events(events: DataFrame) -> DataFrame:
    """Events read as answers of a session: an error is a mark, a signup a
    session's first answer where it stands."""
    return events.select(
        F.col("user_id").alias("session"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        (F.col("event_type") != "signup").alias("admitted"),
        (F.col("event_type") == "error").alias("marked"),
    )


RHYTHM_SQL = """
placed AS (
  SELECT user_id AS session, ts, event_id, event_type <> 'signup' AS admitted, event_type = 'error' AS marked,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
told AS (
  SELECT *, max(CASE WHEN NOT admitted OR marked THEN n END) OVER (PARTITION BY session ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM placed),
read AS (
  SELECT t.session, t.ts, t.marked, t.admitted AND t.marked AND coalesce(p.marked, false) AS ended, t.n - t.last - 1 AS carried
  FROM told t LEFT JOIN placed p ON p.session = t.session AND p.n = t.last),
sums AS (
  SELECT session, count(*) AS answered, count(*) FILTER (WHERE marked) AS met, count(*) FILTER (WHERE ended) AS intervals,
    coalesce(sum(carried) FILTER (WHERE ended), 0) AS carried, min(ts) AS began, max(ts) AS ended FROM read GROUP BY session)
"""


@query(
    "marker_rhythm",
    """SELECT session, answered, met, intervals, round(met * 1000 / answered, 6) AS per_thousand,
         round(CASE WHEN intervals > 0 THEN carried / intervals END, 6) AS between_marks,
         coalesce(intervals >= 5 AND carried / intervals < 7 AND epoch(ended) - epoch(began) >= 600, false) AS crowded FROM sums""",
    ctes=RHYTHM_SQL,
)
def marker_rhythm(t: Tables) -> DataFrame:
    rows = L.marker_rhythm(session_events(t.events), ["session"])
    return rows.select(
        "session", "answered", "met", "intervals", F.round("per_thousand", 6).alias("per_thousand"),
        F.round("between", 6).alias("between_marks"), "crowded",
    )


@query(
    "state_census",
    """WITH told AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00'),
       s AS (SELECT event_type AS state, count(*) FILTER (WHERE next IS NULL) AS entities,
           CAST(sum(epoch_us(coalesce(next, TIMESTAMP '2024-01-15 00:00:00')) - epoch_us(ts)) AS DOUBLE) / 1000000 AS spent,
           coalesce(max(epoch_us(TIMESTAMP '2024-01-15 00:00:00') - epoch_us(ts)) FILTER (WHERE next IS NULL), 0) / 1000000 AS longest
         FROM told GROUP BY 1)
       SELECT state, entities, round(spent, 3) AS spent_seconds, round(longest, 3) AS longest_seconds,
         round(spent / (SELECT sum(spent) FROM s), 6) AS share FROM s""",
)
def state_census(t: Tables) -> DataFrame:
    changes = t.events.select(
        F.col("user_id").alias("entity"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("state")
    )
    rows = L.state_census(changes, F.lit(CENSUS_AT).cast("timestamp"))
    return rows.select(
        "state", "entities", F.round("spent_seconds", 3).alias("spent_seconds"),
        F.round("longest_seconds", 3).alias("longest_seconds"), F.round("share", 6).alias("share"),
    )


@query(
    "outcome_tally",
    """WITH c AS (SELECT user_id % 10 AS road, event_type IN ('view', 'click', 'purchase') AS ok, event_type = 'error' AS broke,
           event_id % 3 = 0 AS intercepts, value AS took FROM events)
       SELECT road, count(*) AS asked, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok AND NOT broke) AS refused,
         count(*) FILTER (WHERE broke) AS broke, count(*) FILTER (WHERE ok AND intercepts) AS intercepts,
         count(*) FILTER (WHERE ok) * 100 // count(*) AS share, round(avg(took), 6) AS each_seconds FROM c GROUP BY road""",
)
def outcome_tally(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    checks = t.events.select(
        (F.col("user_id") % 10).alias("road"), kind.isin("view", "click", "purchase").alias("ok"),
        (kind == "error").alias("broke"), (F.col("event_id") % 3 == 0).alias("intercepts"), F.col("value").alias("took"),
    )
    rows = L.outcome_tally(checks, ["road"])
    return rows.select(
        "road", "asked", "ok", "refused", "broke", "intercepts", "share", F.round("each", 6).alias("each_seconds")
    )


@query(
    "page_speed",
    """WITH n AS (SELECT user_id, max(ts) AS newest FROM events GROUP BY 1),
       r AS (SELECT user_id, count(*) AS n, epoch_us(max(ts)) - epoch_us(min(ts)) AS over FROM events JOIN n USING (user_id)
         WHERE ts >= newest - INTERVAL 2 DAY GROUP BY user_id)
       SELECT user_id, n >= 2 AND over > 0 AS known, round(CASE WHEN n >= 2 AND over > 0 THEN (n - 1) * 60 / (over / 1000000) ELSE 0 END, 6) AS pages_per_minute
       FROM r""",
)
def page_speed(t: Tables) -> DataFrame:
    landed = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = H.page_speed(landed, ["user_id"], "2 days")
    return rows.select("user_id", "known", F.round("pages_per_minute", 6).alias("pages_per_minute"))
