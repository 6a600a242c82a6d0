"""Exact duplicates by skew-safe combining: local copies first, salted digest
groups next, the salts' winners last. Built-in functions only.

Every stage groups by digest *and* text, so two texts that share a digest never
merge. A group of copies of any size leaves each input task as one row, its
rows of all tasks meet under ``salts`` keys, and at most ``salts`` rows meet in
the end. Going back from winners to documents is a join on the digest, whose
hot keys AQE splits; digests that more than one text shares go back by text.

Defined results: a null text counts as empty; any text is compared whole; a
null id ranks below all others; rows that repeat both text and id count in the
group's size, and exactly one of them is kept; an empty table gives no rows;
further columns, whatever their names, are left alone.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import settled

SALTS = 16
# Marks of texts that occur twice, as many as may be broadcast.
BROADCAST_MARKS = 1_000_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _combined(rows: DataFrame, salts: int, totals: Callable[[], list[Column]], merged: Callable[[], list[Column]]):
    """Rows of (__digest, __text, …) to one row per text, in three stages."""
    # The part of a shuffle that runs before it combines within the task: there
    # the salt is one value, so local copies become one row.
    salted = rows.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    by_salt = salted.groupBy("__digest", "__salt", "__text").agg(*totals())
    return by_salt.groupBy("__digest", "__text").agg(*merged())


def _prepared(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")
    ).withColumn("__digest", digest(F.col("__text")))


def groups_of_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: id, ``keep_id`` (largest id of its text),
    ``group_size``, ``kept`` and the text's ``digest``."""
    rows = _prepared(docs, id_col, text_col, digest)
    groups = _combined(
        rows,
        salts,
        lambda: [F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__size")],
        lambda: [F.max("__keep").alias("__keep"), F.sum("__size").alias("__size")],
    )
    texts = settled(groups.drop("__text"), "texts")
    # Rows that repeat text and id are told apart by their count alone.
    per_id = rows.groupBy("__id", "__digest").agg(F.count(F.lit(1)).alias("__rows"))
    shared = settled(texts.groupBy("__digest").count().where("count > 1").select("__digest"), "shared")
    many = texts.where("__size > 1")
    if shared.isEmpty():
        joined = per_id.join(many, "__digest", "left")
    else:
        one = per_id.join(shared, "__digest", "left_anti")
        by_text = rows.join(shared, "__digest").groupBy("__id", "__digest", "__text").agg(
            F.count(F.lit(1)).alias("__rows")
        )
        full = groups.join(shared, "__digest")
        joined = one.join(many.join(shared, "__digest", "left_anti"), "__digest", "left").unionByName(
            by_text.join(full, ["__digest", "__text"]).drop("__text")
        )
    keep = F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep"))
    # A text of a single row has no group to join; repeats of one id have one.
    numbered = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows"))))
    return numbered.select(
        F.col("__id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("__size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("__id").eqNullSafe(keep) & (F.col("__copy") == 1)).alias("kept"),
        F.col("__digest").alias("digest"),
    )


def without_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    salts: int = SALTS,
) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row
    with the largest id (of rows that share it, the one whose other columns
    come last as JSON). Marks of 8 bytes are counted first; a document whose mark
    occurs once is alone and is not shuffled. The others, which a shared mark may
    have brought together, go through the three stages by digest and text."""
    # Columns go by their place, so that no name of theirs can clash.
    held = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != text_col}
    row = F.struct(F.col(f"`{text_col}`").isNull().alias("none"), *[F.col(f"`{c}`").alias(f) for c, f in held.items()])
    rank = F.struct(F.col(f"`{id_col}`").alias("id"), F.to_json(row).alias("rest"))
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"), row.alias("__row"), rank.alias("__rank"))
    rows = rows.withColumn("__mark", F.xxhash64("__text"))
    marks = rows.groupBy("__mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__mark")
    marks = settled(marks, "marks")
    # 16 bytes each where they are broadcast; beyond the bound both sides are shuffled.
    shared = F.broadcast(marks) if marks.count() <= BROADCAST_MARKS else marks
    alone = rows.join(shared, "__mark", "left_anti").select("__text", "__row")
    several = rows.join(shared, "__mark", "left_semi").select("__text", "__row", "__rank")
    best = lambda: [F.max_by("__row", "__rank").alias("__row"), F.max("__rank").alias("__rank")]
    kept = _combined(several.withColumn("__digest", digest(F.col("__text"))), salts, best, best)
    kept = alone.unionByName(kept.select("__text", "__row"))
    back = {c: F.col(f"__row.{f}") for c, f in held.items()} | {text_col: F.when(~F.col("__row.none"), F.col("__text"))}
    return kept.select(*[back[c].alias(c) for c in docs.columns])
