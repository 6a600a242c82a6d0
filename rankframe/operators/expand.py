"""A query list multiplied by formats: macros for the query, letters, numbers.

The (tiny) format text is read on the driver into parts; the values are worked
out from a running number inside the job, never listed on the driver.
"""

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rankframe.functions.urls import strip
from rankframe.operators.running import numbered

MOST = (1 << 63) - 1  # queries are numbered with 64 bits
ROWS_PER_CHUNK = 65536
BLOCK = 1024
CHUNKS_TOGETHER = 4096
# Queries that one task makes and reduces, and tasks they are dealt over at most.
ROWS_PER_TASK, MOST_TASKS = 1 << 19, 1 << 16
DEFAULT_FORMAT = "{query}"


class FormatError(ValueError):
    """A format that cannot be used."""


@dataclass(frozen=True)
class Letters:
    """Words of one to ``rounds`` characters, the shorter first."""

    alphabet: str
    rounds: int

    @property
    def count(self) -> int:
        total = 0
        for r in range(1, self.rounds + 1):
            total += len(self.alphabet) ** r
            if total > MOST:
                break
        return total

    def at(self, k: Column) -> Column:
        n = len(self.alphabet)
        if n == 1:
            return F.repeat(F.lit(self.alphabet), (k + 1).cast("int"))
        word, start = None, 0
        for r in range(1, self.rounds + 1):
            offset = k - start
            digits = [F.floor(offset / n**j) % n for j in reversed(range(r))]
            made = F.concat(*[F.substring(F.lit(self.alphabet), d.cast("int") + 1, F.lit(1)) for d in digits])
            start += n**r
            word = F.when(k < start, made) if word is None else word.when(k < start, made)
        return word


@dataclass(frozen=True)
class Numbers:
    first: int
    last: int

    @property
    def count(self) -> int:
        return self.last - self.first + 1

    def at(self, k: Column) -> Column:
        return (k + self.first).cast("string")


QUERY_PART = object()
_WHOLE = re.compile(r"[+-]?[0-9]+")


def _whole(text: str, what: str) -> int:
    if not _WHOLE.fullmatch(text):
        raise FormatError(f"{what} is not a whole number")
    return int(text)


def _macro(inside: str) -> object | None:
    """One {…} read: the query, a run of values, or None for plain text."""
    name, *rest = inside.split(":")
    if not rest and name.lower() in ("query", "qery"):
        return QUERY_PART
    if name.lower() == "abc" and len(rest) == 3:
        first, last, rounds = rest
        if len(first) != 1 or len(last) != 1:
            raise FormatError("the bounds are one character each")
        if last < first:
            raise FormatError("the last character comes before the first")
        if (n := _whole(rounds, "the number of rounds")) < 1:
            raise FormatError("the rounds are one or more")
        return Letters("".join(map(chr, range(ord(first), ord(last) + 1))), n)
    if name.lower() == "num" and len(rest) == 2:
        values = Numbers(_whole(rest[0], "the first number"), _whole(rest[1], "the last number"))
        if values.count < 1:
            raise FormatError("the last number is below the first")
        return values
    return None


@dataclass(frozen=True)
class Format:
    parts: tuple

    @property
    def count(self) -> int:
        """How many queries it makes of one, counted before any is made."""
        total = 1
        for part in self.parts:
            if isinstance(part, Letters | Numbers):
                total *= part.count
        return total

    def made(self, query: Column, k: Column) -> Column:
        """The k-th query made: the first macro's values are the outermost."""
        pieces, step = [], self.count
        for part in self.parts:
            if part is QUERY_PART:
                pieces.append(query)
            elif isinstance(part, str):
                pieces.append(F.lit(part))
            else:
                step //= part.count
                pieces.append(part.at(F.floor(k / step) % part.count))
        return strip(F.concat(*pieces))


def parse_format(text: str) -> Format:
    parts = []
    for piece in re.split(r"(\{[^}]*\})", text):
        # A brace that opens again before it closes belongs to the macro text.
        known = _macro(piece[1:-1]) if piece.startswith("{") and piece.endswith("}") else None
        if known is not None or piece:
            parts.append(piece if known is None else known)
    if QUERY_PART not in parts:
        raise FormatError("the format has no {query}")
    made = Format(tuple(parts))
    if made.count > MOST:
        raise FormatError("the format makes more queries of each than can be numbered")
    return made


def parse_formats(formats: Sequence[str]) -> list[Format]:
    """A job's formats; blank ones are passed over, none at all is the query."""
    return [parse_format(f.strip()) for f in formats if f.strip()] or [parse_format(DEFAULT_FORMAT)]


@F.pandas_udf(StringType())
def format_fault(formats: pd.Series) -> pd.Series:
    """Why a job's formats cannot be used; null where they can."""

    def fault(texts: Sequence[str] | None) -> str | None:
        try:
            parse_formats([t for t in (() if texts is None else texts) if t is not None])
        except FormatError as problem:
            return str(problem)
        return None

    return formats.map(fault)


def expand_queries(queries: DataFrame, formats: Sequence[str]) -> DataFrame:
    """(ordinal, query) of everything the formats make of (ordinal, text).

    Repeats are kept once over the whole job, the first made winning: reduced
    by aggregation on the text made, so copies never gather in one task. The list
    is counted first: a few bytes of it come to very many queries, so the making is
    dealt over tasks by what is made, not by what is read.
    """
    read = parse_formats(formats)
    counts = F.array(*[F.lit(f.count) for f in read])
    per_query = sum(f.count for f in read)
    asked = queries.select("ordinal", "text", F.posexplode(counts).alias("__f", "__count"))
    blocks = asked.select(
        "ordinal", "text", "__f", "__count", F.explode(F.sequence(F.lit(0), F.floor((F.col("__count") - 1) / BLOCK))).alias("__b")
    )
    # One query may make a million: its blocks go to different tasks.
    tasks = min(MOST_TASKS, -(-queries.count() * per_query // ROWS_PER_TASK))
    if tasks > 1:
        blocks = blocks.repartition(tasks, "ordinal", "__f", "__b")
    last = F.least((F.col("__b") + 1) * BLOCK, F.col("__count")) - 1
    numbers = blocks.select("ordinal", "text", "__f", F.explode(F.sequence(F.col("__b") * BLOCK, last)).alias("__k"))
    made = None
    for at, f in enumerate(read):
        one = f.made(F.col("text"), F.col("__k"))
        made = F.when(F.col("__f") == at, one) if made is None else made.when(F.col("__f") == at, one)
    rows = numbers.select(made.alias("query"), "ordinal", "__f", "__k").where(F.col("query") != "")
    first = rows.groupBy("query").agg(F.min(F.struct("ordinal", "__f", "__k")).alias("__at"))
    flat = first.select("query", F.col("__at.ordinal").alias("__o"), F.col("__at.__f").alias("__f"), F.col("__at.__k").alias("__k"))
    if per_query <= ROWS_PER_CHUNK:
        chunk = [F.floor(F.col("__o") / max(1, ROWS_PER_CHUNK // per_query))]
    else:
        chunk = [F.col("__o"), F.col("__f"), F.floor(F.col("__k") / ROWS_PER_CHUNK)]
    placed = numbered(flat, [], chunk, ["__o", "__f", "__k"], "__n", coarser=CHUNKS_TOGETHER)
    return placed.select((F.col("__n") - 1).alias("ordinal"), "query")
