"""Judging suggestions: by shared words, by closeness in meaning, by filters."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.functions.text import related_words, significant, words
from rankframe.functions.vectors import closeness, length
from rankframe.operators.record import QUERY

# Where the meaning filter starts, and the ends of its range.
DEFAULT_MIN, LOWEST_MIN, HIGHEST_MIN = 0.54, 0.30, 0.80
# The vectors of completions of more pairs than this are broadcast.
PAIRS_OF_ONE = 10_000


def mark_related(pairs: DataFrame, key: str = "key", completion: str = "text") -> DataFrame:
    """Add ``related``: whether a completion has something of its key in it.

    The words of both are cut once per row, before they are compared.
    """
    cut = pairs.withColumns({"__k": significant(words(key)), "__w": words(completion)})
    return cut.withColumn("related", related_words(F.col("__k"), F.col("__w"))).drop("__k", "__w")


def score_pairs(
    pairs: DataFrame, vectors: DataFrame, key: str = "key", completion: str = "text", counted: DataFrame | None = None
) -> DataFrame:
    """Add ``similarity``: the cosine of key and completion.

    ``vectors`` (phrase, vector) holds each phrase once, so a key's vector is
    made once whatever it is paired with. A phrase without a vector leaves its
    pair unscored.

    ``counted`` has the pairs' completions, for less than the pairs cost. Where it
    is given, the completions of very many pairs, a ten-thousandth of the pairs at
    most, have their vectors broadcast: their pairs are not shuffled, each with the
    vector of its key, to one place.
    """

    # A vector's length is worked out once per phrase, before it meets its pairs.
    def named(some: DataFrame, phrase: str, vector: str) -> DataFrame:
        return some.select(F.col("phrase").alias(phrase), F.col("vector").alias(vector), length("vector").alias(f"{vector}_length"))

    keys, texts = named(vectors, key, "__a"), named(vectors, completion, "__b")
    if counted is None:
        both = pairs.join(keys, key, "left").join(texts, completion, "left")
    else:
        counts = counted.groupBy(completion).agg(F.count(F.lit(1)).alias("__n"))
        many = F.broadcast(counts.where(F.col("__n") > PAIRS_OF_ONE).select(completion))
        few = named(vectors.join(many, vectors["phrase"] == many[completion], "left_semi"), completion, "__b")
        common = pairs.join(many, completion, "left_semi").join(keys, key, "left").join(F.broadcast(few), completion, "left")
        others = pairs.join(many, completion, "left_anti").join(keys, key, "left").join(texts, completion, "left")
        both = common.unionByName(others)
    known = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return both.select(*pairs.columns, F.when(known, closeness("__a", "__b", "__a_length", "__b_length")).alias("similarity"))


def unscored_phrases(results: DataFrame, queries: DataFrame) -> DataFrame:
    """The distinct phrases a backfill needs vectors for."""
    rows = results.where(F.col("similarity").isNull()).join(queries.select(*QUERY, "text"), QUERY)
    return rows.select(F.explode(F.array("text", "title")).alias("phrase")).distinct()


def score_backfill(results: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Score a job's unscored suggestions; scored rows are left as they are.

    Running it again scores only what is still unscored. Written over the job's
    partition the outcome is whole or not there.
    """
    scored = results.where(F.col("similarity").isNotNull())
    rows = results.where(F.col("similarity").isNull()).drop("similarity")
    asked = rows.join(queries.select(*QUERY, F.col("text").alias("__key")), QUERY)
    return scored.unionByName(score_pairs(asked, vectors, "__key", "title", rows).drop("__key"))


def threshold(asked: str | float | None) -> float:
    """The meaning filter's threshold, brought into its range."""
    try:
        value = float(asked)
    except (TypeError, ValueError):
        return DEFAULT_MIN
    return DEFAULT_MIN if math.isnan(value) else min(HIGHEST_MIN, max(LOWEST_MIN, value))


def filter_mode(asked: str | None, scored: bool, keep_offtopic: bool = False) -> str:
    """none, words or meaning; meaning asked where nothing is scored is words."""
    if asked in ("none", "words"):
        return asked
    if not asked and keep_offtopic:
        return "none"
    return "meaning" if scored else "words"


def left_out(mode: str, least: float) -> Column:
    """Whether a filter leaves a row out; one never measured goes by its words."""
    if mode == "none":
        return F.lit(False)
    if mode == "meaning":
        return F.col("offtopic") | F.coalesce(F.col("similarity") < least, F.lit(False))
    return F.col("offtopic")


def filter_suggestions(rows: DataFrame, mode: str | None = None, least: str | float | None = None) -> DataFrame:
    """The rows a filter keeps. Without a mode it is meaning in jobs with any
    score and words in the others, decided per job inside the plan."""
    floor = threshold(least)
    if mode in ("none", "words"):
        return rows.where(~left_out(mode, floor))
    # In a job without any score no row is measured, so meaning is words there.
    return rows.where(~left_out("meaning", floor))


def filter_counts(rows: DataFrame, mode: str, least: str | float | None = None) -> DataFrame:
    """Per job, how many suggestions there are and how many a filter cuts."""
    cut = F.count_if(left_out(mode, threshold(least)))
    return rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), cut.alias("cut"))


def score_state(results: DataFrame) -> DataFrame:
    """Per job, whether anything is scored and how much is not."""
    return results.groupBy("job_id").agg(
        (F.count("similarity") > 0).alias("has_scores"), F.count_if(F.col("similarity").isNull()).alias("unscored")
    )
