"""Mixing sources to target weights: tokens per source, a repetition rate each,
and every document floor(rate) times plus one seeded draw for the fraction.

Sources are weighed in code-point order, null last. Targets share ``share`` of
all sizes by weight and stop at ``limit`` times their source's size; what is cut
off is shared again by weight until none is above.

Defined results: a null or empty text has size 0 and is emitted like any other
document (it adds nothing); null is a source of its own; where all sizes are 0
the targets are 0 and nothing is emitted; rows with the same id draw alike; an
empty table gives no rows; further columns are left alone.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import WORD, settled

SHARE, WEIGHTS, LIMIT, SEED = 1.5, (3, 1, 2), 2.0, "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 in code-point order, null last, without a window
    over all of them: ranges are dealt out, numbered each, and carried over."""
    from pyspark.sql import Window

    order = F.col("__source").asc_nulls_last()
    dealt = settled(sources.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("__range").orderBy(order)
    per_range = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # One row per range here, however many sources there are.
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    numbered = dealt.withColumn("__place", F.row_number().over(inside) - 1)
    return numbered.join(offsets, "__range").withColumn("__place", F.col("__place") + F.col("__before"))


def source_targets(
    docs: DataFrame,
    source_col: str = "source",
    text_col: str = "text",
    share: float = SHARE,
    weights: Sequence[int] = WEIGHTS,
    limit: float = LIMIT,
    size: Column | None = None,
) -> DataFrame:
    """One row per source: __source, source_size, target, rate."""
    if not 0 < share <= limit:
        raise ValueError("share must be above 0 and no more than limit")
    sizes = docs.select(
        F.col(source_col).alias("__source"), (word_count(F.col(text_col)) if size is None else size).alias("__size")
    )
    per_source = sizes.groupBy("__source").agg(F.sum("__size").alias("source_size"))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weight = F.get(cycle, (F.col("__place") % len(weights)).cast("int")).cast("long")
    sources = settled(_ranked(per_source).select("__source", "source_size", weight.alias("__weight")), "sources")

    # Only totals come to the driver. A source that is above stays above, since
    # what it leaves only raises the others.
    most = limit * F.col("source_size").cast("double")
    wanted = None
    level, capped = 0.0, -1
    while True:
        above = F.lit(False) if wanted is None else F.col("__weight") * F.lit(level) > most
        total, held, free, n = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(above, F.col("source_size"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("__weight"))), F.lit(0)),
            F.count(F.when(above, 1)),
        ).first()
        if n == capped:
            break
        wanted = share * total
        level, capped = ((wanted - limit * held) / free if free else float("inf")), n
    target = F.least(F.col("__weight") * F.lit(level), most)
    rate = F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.select("__source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, key: Column, seed: str = SEED) -> Column:
    """floor(rate), and one more where the key's draw is below the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 8), 16, 10)
    whole = F.floor(rate)
    return whole + F.when(draw.cast("long") / F.lit(4294967296.0) < rate - whole, 1).otherwise(0)


def weighed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **how) -> DataFrame:
    """One row per document: id, size, source_size, target, rate and copies."""
    sizes = settled(
        docs.select(
            F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), word_count(F.col(text_col)).alias("__size")
        ),
        "sizes",
    )
    targets = settled(source_targets(sizes, "__source", size=F.col("__size"), **how), "targets")
    joined = sizes.withColumnRenamed("__source", "__own").join(
        targets, F.col("__own").eqNullSafe(F.col("__source")), "left"
    )
    return joined.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        "rate",
        copies(F.col("rate"), F.col("__id"), seed).alias("copies"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, **how) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as it is taken."""
    targets = settled(source_targets(docs, source_col, text_col, **how), "targets").select("__source", "rate")
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    joined = row.join(targets, F.col(f"__row.`{source_col}`").eqNullSafe(F.col("__source")))
    times = copies(F.col("rate"), F.col(f"__row.`{id_col}`"), seed).cast("int")
    repeated = joined.where(times > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), times)))
    return repeated.select("__row.*")
