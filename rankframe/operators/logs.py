"""Figures over event logs: rhythm of marks, census of states, tallies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.operators.running import Measure, running

ENOUGH_INTERVALS = 5
CROWDED_BELOW = 7
SETTLING_SECONDS = 600


def _minute(ts: str) -> Column:
    """The chunk of a moment: a minute of one session's or entity's log."""
    return F.date_trunc("minute", ts)


def marked_stretches(events: DataFrame) -> DataFrame:
    """Per session, the stretches between a mark and the next.

    ``events``: session, ts, event_id, admitted, marked. An event not admitted
    starts the count again; a mark ends a stretch where the last such event was
    a mark too. Gives answered, met, intervals, carried.

    A chunk of a session's log is folded into one summary: what it closes inside,
    where its first and last restart stand and what they are. Summaries are merged
    along the session, so the events are shuffled once, by session and chunk.
    """
    part = ["session", "__chunk"]
    inside = Window.partitionBy(*part).orderBy("ts", "event_id")
    restart = ~F.col("admitted") | F.col("marked")
    closes = F.col("admitted") & F.col("marked")
    placed = events.withColumn("__chunk", _minute("ts")).withColumn("__n", F.row_number().over(inside).cast("long"))
    here = F.when(restart, F.struct(F.col("__n").alias("n"), F.col("marked").alias("marked"), closes.alias("closes")))
    placed = placed.withColumn("__here", here)
    last = F.last("__here", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    told = placed.withColumn("__last", last)
    ended = closes & F.coalesce(F.col("__last.marked"), F.lit(False))
    chunks = told.groupBy(*part).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("marked").alias("met"),
        F.count_if(ended).alias("intervals"),
        F.coalesce(F.sum(F.when(ended, F.col("__n") - F.col("__last.n") - 1)), F.lit(0)).alias("carried"),
        F.min("__here").alias("first"),
        F.max("__here").alias("last"),
        F.min("ts").alias("began"),
        F.max("ts").alias("ended"),
    )
    earlier = Window.partitionBy("session").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    merged = chunks.withColumn("__before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    open_ = F.when(F.col("last").isNotNull(), F.struct((F.col("__before") + F.col("last.n")).alias("n"), F.col("last.marked").alias("marked")))
    merged = merged.withColumn("__open", open_).withColumn("__open", F.last("__open", ignorenulls=True).over(earlier))
    # A chunk's first restart may close what an earlier chunk left open.
    joins = F.coalesce(F.col("first.closes") & F.col("__open.marked"), F.lit(False))
    across = F.col("__before") + F.col("first.n") - F.col("__open.n") - 1
    return merged.groupBy("session").agg(
        F.sum("n").alias("answered"),
        F.sum("met").alias("met"),
        (F.sum("intervals") + F.count_if(joins)).alias("intervals"),
        (F.sum("carried") + F.coalesce(F.sum(F.when(joins, across)), F.lit(0))).alias("carried"),
        F.min("began").alias("began"),
        F.max("ended").alias("ended"),
    )


def rhythm_of(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches summed over groups of sessions and read as a rhythm."""
    sums = stretches.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("answered", "met", "intervals", "carried")],
        F.min("began").alias("began"), F.max("ended").alias("ended"),
    )
    known = F.col("intervals") > 0
    between = F.when(known, F.col("carried") / F.col("intervals"))
    ran = F.unix_seconds(F.col("ended").cast("timestamp")) - F.unix_seconds(F.col("began").cast("timestamp"))
    crowded = (ran >= SETTLING_SECONDS) & (F.col("intervals") >= ENOUGH_INTERVALS) & (between < CROWDED_BELOW)
    return sums.select(
        *keys, "answered", "met", "intervals",
        (F.col("met") * 1000 / F.col("answered")).alias("per_thousand"),
        between.alias("between"),
        F.coalesce(crowded, F.lit(False)).alias("crowded"),
    )


def marker_rhythm(events: DataFrame, keys: list[str]) -> DataFrame:
    """How often marks fall, per group of sessions."""
    return rhythm_of(marked_stretches(events), keys)


def state_census(changes: DataFrame, as_of: Column) -> DataFrame:
    """Where entities stand at a moment and where their time has gone.

    ``changes``: entity, ts, event_id, state. A state lasts until the entity's
    next change; the one it is in lasts until ``as_of``.
    """
    told = changes.where(F.col("ts") <= as_of)
    following = running(
        told, ["entity"], [_minute("ts")], ["ts", "event_id"],
        {"__next": Measure("min", F.col("ts"), inclusive=False)}, descending=True,
    )
    until = F.coalesce(F.col("__next"), as_of)

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    spent = micros(until) - micros(F.col("ts"))
    standing = F.col("__next").isNull()
    per_state = following.groupBy("state").agg(
        F.count_if(standing).alias("entities"),
        F.sum(spent).alias("__spent"),
        F.coalesce(F.max(F.when(standing, spent)), F.lit(0)).alias("__longest"),
    )
    # One row per state here.
    whole = F.sum("__spent").over(Window.partitionBy())
    return per_state.select(
        "state",
        "entities",
        (F.col("__spent") / 1_000_000).alias("spent_seconds"),
        (F.col("__longest") / 1_000_000).alias("longest_seconds"),
        F.when(whole > 0, F.col("__spent") / whole).otherwise(F.lit(0.0)).alias("share"),
    )


def outcome_tally(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Checks by outcome per group (ok, broke, intercepts, took seconds)."""
    asked = F.count(F.lit(1))
    ok, broke = F.count_if("ok"), F.count_if("broke")
    return checks.groupBy(*keys).agg(
        asked.alias("asked"),
        ok.alias("ok"),
        (asked - ok - broke).alias("refused"),
        broke.alias("broke"),
        F.count_if(F.col("ok") & F.col("intercepts")).alias("intercepts"),
        F.floor(ok * 100 / asked).alias("share"),
        F.avg("took").alias("each"),
    )
