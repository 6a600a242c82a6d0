"""The recording, judging and speed operators over streams.

Each function takes streaming DataFrames and gives one back, or starts nothing:
the caller picks sink, trigger and checkpoint. Only ``record_batch`` writes; it
is made for ``foreachBatch``.
"""

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankframe.functions.vectors import closeness
from rankframe.operators import pages as P
from rankframe.operators.judge import mark_related
from rankframe.operators.layouts import Layout, record_line
from rankframe.operators.record import QUERY, cumulative_rank, first_places, first_seen, keep_aside, keep_fields, seen_key
from rankframe.schemas import SEEN

RHYTHM_OUT = "session bigint, answered bigint, met bigint, intervals bigint, carried bigint"
RHYTHM_STATE = "checked boolean, since bigint, answered bigint, met bigint, intervals bigint, carried bigint"


def stream_first_seen(results: DataFrame, by: Column | str, within: tuple[str, str] | None = None) -> DataFrame:
    """A repeat dropped as it arrives, per job; rows without a key pass.

    The keys seen are kept for good, as the promise needs. With ``within`` =
    (moment column, delay) they are forgotten after the delay: less state, and
    a repeat that comes later than that passes. Copies are shuffled by key before
    the state sees them: where one key makes up much of a stream, ``record_batch``
    reduces the copies of a batch first.
    """
    keyed = results.withColumn("__key", seen_key(by))
    alone, known = keyed.where("__key is null"), keyed.where("__key is not null")
    if within is None:
        kept = known.dropDuplicates(["job_id", "__key"])
    else:
        kept = known.withWatermark(*within).dropDuplicatesWithinWatermark(["job_id", "__key"])
    return kept.unionByName(alone).drop("__key")


def record_batch(root: str, jobs: DataFrame) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` does with settled queries' rows: rank, drop
    repeats, keep the job's fields, add to the recorded results.

    A batch writes partitions of its own number, so one done again after a
    failure replaces what it wrote and never counts its own keys as seen.
    A query's rows must come in one batch.
    """
    root = root.rstrip("/")
    rules = jobs.select("job_id", "unique_by", "fields")

    def record(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        ranked = cumulative_rank(batch).join(rules, "job_id")
        # The keys are worked out once, for the repeats and for what is remembered.
        places = first_places(batch.join(rules, "job_id"), "unique_by")
        places.write.mode("overwrite").parquet(f"{root}/places/epoch={number}")
        places = spark.read.schema(places.schema).parquet(f"{root}/places/epoch={number}")
        seen = None
        if number > 0:
            told = T.StructType([*SEEN.fields, T.StructField("epoch", T.LongType())])
            seen = spark.read.schema(told).parquet(f"{root}/seen").where(F.col("epoch") < number)
        first = first_seen(ranked, "unique_by", seen, places)
        kept = keep_fields(first, "fields").select(*batch.columns, "rank")
        kept.write.mode("overwrite").parquet(f"{root}/results/epoch={number}")
        known = places.where("key is not null").select("job_id", "key")
        known.write.mode("overwrite").parquet(f"{root}/seen/epoch={number}")

    return record


def record_captures(root: str, jobs: DataFrame) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` does with captured pages (``read_captures`` columns):
    every part of a query's record. Results go through ``record_batch``; ads and
    related searches where the job keeps them, pages that were read, what each
    job's filter dropped, and each query's outcome are written beside them, all
    under the batch's own number. A query's pages must come in one batch.
    """
    root = root.rstrip("/")
    results_of = record_batch(root, jobs)
    rules = jobs.select("job_id", "unique_by", "fields")

    def record(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession

        def write(rows: DataFrame, name: str) -> DataFrame:
            path = f"{root}/{name}/epoch={number}"
            rows.write.mode("overwrite").parquet(path)
            return spark.read.schema(rows.schema).parquet(path)

        # Read once; everything else is made from what was read.
        read = write(P.extract_serps(batch), "serps")
        found = P.organic_results(read, [*QUERY, "page"]).withColumns(
            {"offtopic": F.lit(False), "similarity": F.lit(None).cast("double")}
        )
        results_of(found, number)
        kept = spark.read.parquet(f"{root}/results/epoch={number}").groupBy("job_id").agg(F.count(F.lit(1)).alias("kept"))
        counted = found.groupBy("job_id").agg(F.count(F.lit(1)).alias("found")).join(kept, "job_id", "left")
        write(counted.select("job_id", (F.col("found") - F.coalesce("kept", F.lit(0))).alias("dropped")), "dropped")
        for name, rows in (("ads", P.ads(read, [*QUERY, "page"])), ("related", P.related_searches(read, [*QUERY, "page"]))):
            write(keep_aside(rows.join(rules, "job_id"), "fields", name).select(*rows.columns), name)
        write(P.usable(read).select(*QUERY, "page", "origin"), "pages")
        # A query fails with what its first unusable page was.
        broken = F.min(F.when(~F.col("class").isin("serp", "empty"), F.struct("page", "class")))["class"]
        state = read.groupBy(*QUERY).agg(broken.alias("__class"))
        err = F.when(F.col("__class").isNull(), "").otherwise(F.concat(F.lit("page refused (class "), "__class", F.lit(")")))
        write(state.select(*QUERY, err.alias("err"), F.current_timestamp().alias("settled_at")), "outcomes")

    return record


def stream_pace(settled: DataFrame, delay: str = "10 minutes", window: str = "5 minutes", every: str = "1 minute") -> DataFrame:
    """Queries and pages settled per job in a window that moves on every minute.

    The watermark is our own choice: a moment later than ``delay`` is not counted.
    """
    return (
        settled.withWatermark("settled_at", delay)
        .groupBy("job_id", F.window("settled_at", window, every).alias("window"))
        .agg(
            F.count(F.lit(1)).alias("moments"),
            F.sum("pages").alias("pages"),
            F.min("settled_at").alias("first"),
            F.max("settled_at").alias("last"),
        )
        .select("job_id", F.col("window.start").alias("from"), F.col("window.end").alias("to"), "moments", "pages", "first", "last")
    )


def _rhythm(key: tuple[Any, ...], batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One session's new events added to its totals.

    An event that is marked, or not admitted, begins a stretch. An admitted mark
    in a stretch that a mark began closes an interval as long as the stretch so far.
    """
    begun_by_mark, length, answered, met, intervals, carried = state.get if state.exists else (False, 0, 0, 0, 0, 0)
    events = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    admitted, marked = events["admitted"].to_numpy(bool), events["marked"].to_numpy(bool)
    begins = marked | ~admitted
    at = np.arange(len(events))
    # Where the stretch that each event comes upon began; -1: before this batch.
    start = np.concatenate([[-1], np.maximum.accumulate(np.where(begins, at, -1))])
    by_mark = np.where(start >= 0, marked[np.maximum(start, 0)], begun_by_mark)
    so_far = np.where(start >= 0, np.append(at, len(at)) - start - 1, np.append(at, len(at)) + length)
    closes = admitted & marked & by_mark[:-1]
    answered, met = answered + len(at), met + int(marked.sum())
    intervals, carried = intervals + int(closes.sum()), carried + int(so_far[:-1][closes].sum())
    state.update((bool(by_mark[-1]), int(so_far[-1]), answered, met, intervals, carried))
    yield pd.DataFrame({
        "session": [key[0]], "answered": [answered], "met": [met], "intervals": [intervals], "carried": [carried],
    })


def stream_rhythm(events: DataFrame) -> DataFrame:
    """The stretches between marks, counted on as events arrive, per session.

    Gives a session's totals each time it has new events (update mode). Within
    a micro-batch events are put in order of ts; the trigger bounds how many a
    session brings at once.
    """
    told = events.select("session", "ts", "event_id", "admitted", "marked")
    return told.groupBy("session").applyInPandasWithState(
        _rhythm, RHYTHM_OUT, RHYTHM_STATE, "update", GroupStateTimeout.NoTimeout
    )


def stream_score(suggestions: DataFrame, vectors: DataFrame, key: str = "key", completion: str = "text") -> DataFrame:
    """New suggestions judged as they arrive, by words and against a static
    table (phrase, vector); without a vector a suggestion stays unscored."""
    keys = vectors.select(F.col("phrase").alias(key), F.col("vector").alias("__a"))
    texts = vectors.select(F.col("phrase").alias(completion), F.col("vector").alias("__b"))
    both = mark_related(suggestions, key, completion).join(keys, key, "left").join(texts, completion, "left")
    known = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.select(
        *suggestions.columns, (~F.col("related")).alias("offtopic"), F.when(known, closeness("__a", "__b")).alias("similarity")
    )


def stream_export(rows: DataFrame, layout: Layout) -> DataFrame:
    """Rows as lines for an appending text sink."""
    return rows.select(record_line(layout).alias("value"))


def in_flight_counts(captured: DataFrame, recorded: DataFrame, keys: Sequence[str] = ("job_id",)) -> DataFrame:
    """Captured but not yet recorded results per job, from two streams."""
    ways = captured.select(*keys, F.lit(1).alias("__way")).unionByName(recorded.select(*keys, F.lit(-1).alias("__way")))
    return ways.groupBy(*keys).agg(F.greatest(F.lit(0), F.sum("__way")).alias("in_flight"))

