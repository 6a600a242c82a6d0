"""Phrases cut into a vocabulary's pieces, and turned into vectors.

The vocabulary is a table (piece, id, score[, scale, q]) of any size: the
pieces of a phrase are found by joining its substrings with the table, and only
the choice of the best cut, a few lines over one phrase, runs in Python.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.functions.urls import SPACE_RUN, SPACES, _col, let
from rankframe.functions.vectors import dequantised, unit

UNKNOWN_PENALTY = 10.0
SPACE_MARK = "▁"
# ASCII punctuation: each mark stands by itself.
_PUNCTUATION = r"([!-/:-@\[-`{-~])"


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def composed(c: Column | str) -> Column:
    """A text in compatibility composition (half-width forms, ligatures, letters
    with their accents apart). Texts of ASCII alone are not handed to Python."""
    c = _col(c)
    return F.coalesce(_composed(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def normalise_phrase(c: Column | str) -> Column:
    """A phrase as the pieces are written: composed, marks spaced, blanks as ▁, one in front."""
    spaced = F.regexp_replace(F.regexp_replace(composed(c), " {2,}", " "), _PUNCTUATION, " $1 ")
    flat = F.btrim(F.regexp_replace(spaced, SPACE_RUN, " "), F.lit(SPACES))
    marked = let(flat, lambda f: F.when(f != "", F.concat(F.lit(SPACE_MARK), F.replace(f, F.lit(" "), F.lit(SPACE_MARK)))))
    return F.coalesce(marked, F.lit(""))


def _best_cut(edges: list, length: int, unknown_id: int, unknown_score: float) -> list[int]:
    """The pieces of the highest total score from 0 to ``length``; characters
    no piece covers are unknown, a run of them one unknown piece."""
    by_start: dict[int, list] = {}
    for e in edges:
        by_start.setdefault(e["start"], []).append((e["start"] + e["length"], e["score"], e["id"]))
    best: list = [None] * (length + 1)
    best[0] = (0.0, -1, -1)
    for at in range(length):
        if best[at] is None:
            continue
        ways = sorted(by_start.get(at, ()))
        if not any(end == at + 1 for end, _, _ in ways):
            ways.append((at + 1, unknown_score, unknown_id))
        for end, score, piece in ways:
            total = best[at][0] + score
            if best[end] is None or total > best[end][0]:
                best[end] = (total, at, piece)
    out: list[int] = []
    end = length
    while end > 0:
        _, start, piece = best[end]
        if not (out and piece == unknown_id and out[-1] == unknown_id):
            out.append(piece)
        end = start
    return out[::-1]


@F.pandas_udf(T.ArrayType(T.LongType()))
def _cut(edges: pd.Series, length: pd.Series, unknown_id: pd.Series, unknown_score: pd.Series) -> pd.Series:
    asked = zip(edges, length, unknown_id, unknown_score)
    return pd.Series([_best_cut(list(e), int(n), int(u), float(s)) for e, n, u, s in asked])


def tokenise_phrases(phrases: DataFrame, vocab: DataFrame, unknown_id: int) -> DataFrame:
    """(phrase, tokens) of each distinct phrase: its pieces' ids in order.

    Spans travel under a digest of their phrase, not with its text.
    """
    pieces = vocab.where(F.col("id") != unknown_id).select("piece", "id", F.col("score").cast("double").alias("score"))
    bounds = pieces.agg(
        F.max(F.char_length("piece")).alias("longest"), (F.min("score") - UNKNOWN_PENALTY).alias("unknown_score")
    )
    # One row: how far a piece reaches, and what an unknown character costs.
    longest, unknown_score = bounds.first()
    once = phrases.select("phrase").distinct().withColumn("text", normalise_phrase("phrase"))
    once = once.withColumns({"n": F.char_length("text"), "longest": F.lit(longest or 0), "key": F.md5("phrase")})
    starts = once.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    spans = starts.select(
        "key", "start", F.substring(F.col("text"), F.col("start") + 1, F.col("longest")).alias("rest"),
    ).select("key", "start", F.explode(F.sequence(F.lit(1), F.char_length("rest"))).alias("length"), "rest")
    spans = spans.select("key", "start", "length", F.substring(F.col("rest"), F.lit(1), F.col("length")).alias("piece"))
    found = spans.join(pieces, "piece")
    edges = found.groupBy("key").agg(F.collect_list(F.struct("start", "length", "score", "id")).alias("edges"))
    none = F.array().cast("array<struct<start:int,length:int,score:double,id:bigint>>")
    ready = once.join(edges, "key", "left").select(
        "phrase",
        F.coalesce(F.col("edges").cast("array<struct<start:int,length:int,score:double,id:bigint>>"), none).alias("edges"),
        "n",
        F.lit(unknown_id).alias("u"),
        F.lit(-UNKNOWN_PENALTY if unknown_score is None else unknown_score).alias("s"),
    )
    return ready.select("phrase", _cut("edges", "n", "u", "s").alias("tokens"))


def embed_phrases(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(phrase, vector): the direction of the sum of the pieces' vectors.

    Each dimension is a sum of its own, taken in part before the shuffle, so a
    phrase of any length is one row from each task; a phrase without pieces gets
    the nought vector.
    """
    # One number: how many sums there are.
    dims = vocab.agg(F.max(F.size("q"))).first()[0] or 0
    rows = vocab.select("id", dequantised("scale", "q").alias("row"))
    counted = tokens.select("phrase", F.explode("tokens").alias("id")).groupBy("phrase", "id").agg(F.count(F.lit(1)).alias("n"))
    sums = counted.join(rows, "id").groupBy("phrase").agg(*[F.sum(F.get("row", F.lit(i)) * F.col("n")).alias(f"d{i}") for i in range(dims)])
    every = tokens.select("phrase").join(sums, "phrase", "left")
    total = F.array(*[F.coalesce(f"d{i}", F.lit(0.0)) for i in range(dims)]).cast("array<double>")
    return every.select("phrase", unit(total).alias("vector"))
