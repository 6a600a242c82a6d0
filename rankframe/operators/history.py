"""Questions over the recorded tables.

Ordered answers end in ``orderBy``: a range sort across the cluster, or a
bounded top-k where there is a limit. Only done queries answer a check.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.functions.urls import class_in_text
from rankframe.operators.record import QUERY

PACE_WINDOW = "5 minutes"
# The order refusals are listed in where they are as common.
REASONS = ("wall", "banned", "shell", "http", "empty", "serp", "silent")
PAGE = ["job_id", "ordinal", "page"]


def _of(frame: DataFrame, job: int | None) -> DataFrame:
    return frame if job is None else frame.where(F.col("job_id") == job)


def _texts(queries: DataFrame, job: int | None) -> DataFrame:
    return _of(queries, job).select(*QUERY, F.col("text").alias("query"))


def job_rows(queries: DataFrame, results: DataFrame, job: int | None = None) -> DataFrame:
    """A job's results with their queries, in list order then rank."""
    return _of(results, job).join(_texts(queries, job), QUERY).orderBy("job_id", "ordinal", "rank")


def job_ads(queries: DataFrame, ads: DataFrame, job: int | None = None) -> DataFrame:
    return _of(ads, job).join(_texts(queries, job), QUERY).orderBy("job_id", "ordinal", "page", "position")


def job_related(queries: DataFrame, related: DataFrame, job: int | None = None) -> DataFrame:
    """Related searches of a job; the phrase is ``text``, as exports call it."""
    phrases = _of(related, job).withColumnRenamed("query", "text")
    return phrases.join(_texts(queries, job), QUERY).orderBy("job_id", "ordinal", "page", "position")


def _answers(queries: DataFrame, results: DataFrame, job: int | None, figure: Column) -> DataFrame:
    """Done queries with one figure over their results, counted before the join."""
    done = _of(queries, job).where(F.col("state") == "done")
    per_query = _of(results, job).groupBy(*QUERY).agg(figure.alias("__figure"))
    return done.join(per_query, QUERY, "left")


def verdicts(queries: DataFrame, results: DataFrame, job: int | None = None) -> DataFrame:
    """Whether each checked address is held: it has results recorded."""
    held = F.coalesce(F.col("__figure"), F.lit(0)) > 0
    return _answers(queries, results, job, F.count(F.lit(1))).select(
        *QUERY, F.col("text").alias("target"), held.alias("held"), "settled_at"
    )


def standings(queries: DataFrame, results: DataFrame, job: int | None = None) -> DataFrame:
    """The best rank recorded for each checked phrase, 0 where there is none."""
    rank = F.coalesce(F.col("__figure"), F.lit(0))
    return _answers(queries, results, job, F.min("rank")).select(
        *QUERY, F.col("text").alias("query"), rank.alias("rank"), (rank > 0).alias("found"), "settled_at"
    )


def site_history(jobs: DataFrame, queries: DataFrame, results: DataFrame, host: str) -> DataFrame:
    """Every place a host has held, oldest job first. The host is compared as
    recorded, so the filter reaches the scan."""
    rows = results.where(F.col("host") == host)
    runs = jobs.select("job_id", F.col("name").alias("job_name"), F.col("created_at").alias("taken_at"))
    return (
        rows.join(_texts(queries, None), QUERY)
        .join(runs, "job_id")
        .select("job_id", "job_name", "taken_at", "ordinal", "query", "page", "rank", "url")
        .orderBy("taken_at", "job_id", "ordinal", "rank")
    )


def failures(queries: DataFrame, job: int | None = None) -> DataFrame:
    return _of(queries, job).where(F.col("state") == "failed").select(*QUERY, "err").orderBy("job_id", "ordinal")


def failure_breakdown(queries: DataFrame, job: int | None = None) -> DataFrame:
    """Refusals by what came back, commonest first, ties in declared order."""
    reason = F.coalesce(class_in_text("err"), F.lit("silent"))
    place = F.array_position(F.array(*[F.lit(r) for r in REASONS]), F.col("reason"))
    return (
        failures(queries, job)
        .groupBy("job_id", reason.alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("job_id", F.col("n").desc(), place)
    )


def _states() -> list[Column]:
    one = [F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed", "pending")]
    return [F.count("ordinal").alias("total"), *one]


def progress(queries: DataFrame, job: int | None = None) -> DataFrame:
    """Queries of a job by state."""
    return _of(queries, job).groupBy("job_id").agg(*_states())


def success_share(queries: DataFrame, job: int | None = None) -> DataFrame:
    """Done of settled in whole per cent, a dash where none is settled."""
    settled = F.col("done") + F.col("failed")
    share = F.concat(F.floor(F.col("done") * 100 / settled).cast("string"), F.lit("%"))
    return progress(queries, job).select(
        "job_id", "done", "failed", F.when(settled > 0, share).otherwise(F.lit("—")).alias("share")
    )


def job_summaries(jobs: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """Jobs with their counts, newest first; jobs without queries included. With
    a limit the newest jobs are picked first, and only theirs are counted."""
    newest = [F.col("created_at").desc(), F.col("job_id").desc()]
    shown = jobs if limit is None else jobs.orderBy(*newest).limit(limit)
    asked = queries if limit is None else queries.join(shown.select("job_id"), "job_id", "left_semi")
    named = ("total", "done", "failed", "pending")
    rows = shown.join(progress(asked), "job_id", "left").select(
        "job_id", "name", "created_at", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in named]
    )
    return rows.orderBy(*newest)


def result_count(results: DataFrame, job: int | None = None) -> DataFrame:
    return _of(results, job).groupBy("job_id").agg(F.count(F.lit(1)).alias("results"))


def latest_rows(queries: DataFrame, results: DataFrame, job: int, limit: int) -> DataFrame:
    """A job's last results, newest first: a bounded top-k, no full sort."""
    newest = [F.col("settled_at").desc_nulls_last(), F.col("ordinal").desc(), F.col("rank").desc()]
    when = _of(queries, job).select(*QUERY, F.col("text").alias("query"), "settled_at")
    return _of(results, job).join(when, QUERY).orderBy(*newest).limit(limit)


def _latest(answer: Callable[..., DataFrame], queries: DataFrame, results: DataFrame, job: int, limit: int) -> DataFrame:
    """The answers for a job's last settled queries, which are picked before
    anything is counted."""
    newest = [F.col("settled_at").desc_nulls_last(), F.col("ordinal").desc()]
    shown = _of(queries, job).where(F.col("state") == "done").orderBy(*newest).limit(limit)
    theirs = _of(results, job).join(shown.select(*QUERY), QUERY, "left_semi")
    return answer(shown, theirs, job).orderBy(*newest)


def latest_verdicts(queries: DataFrame, results: DataFrame, job: int, limit: int) -> DataFrame:
    return _latest(verdicts, queries, results, job, limit)


def latest_standings(queries: DataFrame, results: DataFrame, job: int, limit: int) -> DataFrame:
    return _latest(standings, queries, results, job, limit)


def _speed(moments: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Speed over moments already cut to their window, by aggregation alone:
    what the oldest one took is taken off the sum."""
    figures = moments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min("settled_at").alias("__from"),
        F.max("settled_at").alias("__to"),
        F.sum("pages").alias("__pages"),
        F.min_by("pages", F.struct(*order)).alias("__first"),
    )
    over = F.unix_micros("__to") - F.unix_micros("__from")
    known = (F.col("__n") >= 2) & (over > 0)
    seconds = over / F.lit(1_000_000.0)
    settled = F.col("__n") - 1
    pages = F.col("__pages") - F.col("__first")
    return figures.select(
        *keys,
        known.alias("known"),
        F.when(known, settled).otherwise(F.lit(0)).alias("settled"),
        F.when(known, pages).otherwise(F.lit(0)).alias("pages"),
        F.when(known, seconds).otherwise(F.lit(0.0)).alias("over_seconds"),
        F.when(known, settled * 60 / seconds).otherwise(F.lit(0.0)).alias("per_minute"),
        F.when(known, pages * 60 / seconds).otherwise(F.lit(0.0)).alias("pages_per_minute"),
    )


def pace(queries: DataFrame, pages: DataFrame, as_of: Column, window: str = PACE_WINDOW) -> DataFrame:
    """How fast each job settles queries in the window before ``as_of``."""
    recent = queries.where(F.col("settled_at").isNotNull() & (F.col("settled_at") >= as_of - F.expr(f"interval {window}")))
    per_query = pages.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("pages"))
    moments = recent.join(per_query, QUERY, "left").fillna(0, ["pages"])
    return _speed(moments, ["job_id"], ["settled_at", "ordinal"])


def page_speed(landed: DataFrame, keys: list[str], window: str = PACE_WINDOW) -> DataFrame:
    """Pages a minute in the window that ends at the newest page of each group.

    ``landed`` has the group's keys and ``ts``. The newest moment per group is
    a reduced aggregate joined back on the group.
    """
    newest = landed.groupBy(*keys).agg(F.max("ts").alias("__newest"))
    recent = landed.join(newest, keys).where(F.col("ts") >= F.col("__newest") - F.expr(f"interval {window}"))
    figures = recent.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("ts").alias("__from"), F.max("ts").alias("__to"))
    over = (F.unix_micros("__to") - F.unix_micros("__from")) / F.lit(1_000_000.0)
    known = (F.col("__n") >= 2) & (over > 0)
    return figures.select(
        *keys,
        known.alias("known"),
        F.when(known, (F.col("__n") - 1) * 60 / over).otherwise(F.lit(0.0)).alias("pages_per_minute"),
    )


def remaining(
    jobs: DataFrame, queries: DataFrame, pages: DataFrame, as_of: Column, window: str = PACE_WINDOW
) -> DataFrame:
    """What is left of each job at its present pace, and how long it has run."""
    speed = pace(queries, pages, as_of, window).select("job_id", "known", "per_minute")
    counts = progress(queries).select("job_id", "pending")
    rest = F.when(F.col("known") & (F.col("pending") > 0), F.col("pending") * 60 / F.col("per_minute"))
    elapsed = (F.unix_micros(as_of) - F.unix_micros("created_at")) / F.lit(1_000_000.0)
    return (
        jobs.join(counts, "job_id", "left")
        .join(speed, "job_id", "left")
        .select(
            "job_id",
            F.coalesce("pending", F.lit(0)).alias("pending"),
            rest.alias("remaining_seconds"),
            elapsed.alias("elapsed_seconds"),
        )
    )
