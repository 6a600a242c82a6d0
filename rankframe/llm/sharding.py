"""Sharding by a two-pass external shuffle: records are scattered into
memory-sized buckets by seeded hashes, then each bucket is shuffled by
Fisher-Yates in one task and written.

The shard follows from the key and the number of shards alone (the shard whose
seeded hash of the key is highest), so one more shard takes records only into
itself. Within a shard a second hash picks the bucket; the number of a shard's
buckets follows from its own bytes, so a bucket's size stays the same at any
scale, also where one key holds a third of all rows. Rows with equal key and text
that come to much of a bucket are numbered in the order of their whole rows, by
ranges, and their number picks the bucket too.

Before it is shuffled a bucket is put in the order of a hash over whole rows, so
the places do not depend on how rows arrive; rows that are equal throughout may
stand for one another.

Defined results: a null text has no bytes; a null key is a key like any other;
rows with the same key share a shard, and are spread over its buckets by their
text, and by number where texts are equal too; an empty table gives no rows;
further columns are carried along, and one that is named like an output column
is refused.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.llm.common import settled
from rankframe.llm.merkle import placed

SHARDS, BUCKET_BYTES, LEAST_BUCKETS, SEED = 16, 16 << 20, 4, 20240229
OWN = ("shard", "bucket", "place")


def size_of(text: Column) -> Column:
    """Bytes of the text in UTF-8, plus one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _chance(key: Column, shard: int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(shard), key)


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of the key; ties go to the higher number."""
    if shards == 1:
        return F.lit(0)
    return F.greatest(*[F.struct(_chance(key, i, seed).alias("h"), F.lit(i).alias("i")) for i in range(shards)])["i"]


def _shuffled(seed: int):
    def shuffle(key: tuple, bucket: pa.Table) -> pa.Table:
        """A fixed order first, since rows arrive in any; then the permutation."""
        order = pc.sort_indices(bucket.column("__row"))
        rng = np.random.default_rng([seed, key[0].as_py(), key[1].as_py()])
        # numpy's shuffle is Fisher-Yates.
        places = np.array(order)
        rng.shuffle(places)
        out = bucket.take(pa.array(places)).drop_columns(["__row"])
        return out.set_column(out.schema.get_field_index("place"), "place", pa.array(np.arange(len(out)), pa.int64()))

    return shuffle


def scattered(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    bucket_bytes: int = BUCKET_BYTES,
    seed: int = SEED,
) -> DataFrame:
    """The documents in shuffled buckets: their columns, shard, bucket, place."""
    if clash := [c for c in docs.columns if c.lower() in OWN]:
        raise ValueError(f"rename these columns first: {clash}")
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # One row per shard comes to the driver.
    sizes = docs.groupBy(shard_of(key, shards, seed).alias("shard")).agg(F.sum(size_of(text)).alias("n")).collect()
    buckets = {r["shard"]: max(LEAST_BUCKETS, math.ceil(r["n"] / bucket_bytes)) for r in sizes}
    by_shard = F.array(*[F.lit(buckets.get(i, LEAST_BUCKETS)) for i in range(shards)])
    whole = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        shard_of(key, shards, seed).alias("shard"),
        F.xxhash64(F.lit(~seed), key, text).alias("__mark"),
        F.xxhash64(whole).alias("__row"),
    )
    per_mark = rows.groupBy("__mark").agg(F.sum(size_of(F.col(names[text_col]))).alias("n"))
    heavy = settled(per_mark.where(F.col("n") > bucket_bytes // 4).select("__mark"), "heavy")
    salted = rows.withColumn("__salt", F.col("__mark"))
    if not heavy.isEmpty():
        hot = placed(rows.join(heavy, "__mark", "left_semi"), "__mark", ["__row"], "hot").drop("size")
        hot = hot.withColumn("__salt", F.xxhash64("__mark", "place")).drop("place")
        salted = salted.join(heavy, "__mark", "left_anti").unionByName(hot)
    dealt = salted.select(
        *names.values(), "shard", F.pmod(F.col("__salt"), F.get(by_shard, F.col("shard"))).cast("int").alias("bucket"),
        F.lit(0).cast("long").alias("place"), "__row",
    )
    # As many tasks as buckets, whatever the session's own number is.
    dealt = dealt.repartition(max(1, sum(buckets.values())), "shard", "bucket")
    out = dealt.groupBy("shard", "bucket").applyInArrow(_shuffled(seed), dealt.drop("__row").schema)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *OWN)


def with_slots(placed: DataFrame) -> DataFrame:
    """Rows with shard, bucket and place: buckets of a shard follow one another,
    and ``slot`` counts through them. Where only some columns are wanted, select
    them first: with very many buckets the rows are shuffled for it."""
    counts = placed.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # Written first, so that its size is known where the join is planned.
    offsets = settled(offsets, "offsets")
    return placed.join(offsets, ["shard", "bucket"]).withColumn("slot", F.col("__before") + F.col("place")).drop("__before")


def write_shards(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Both passes, written to ``path`` (or to the shared folder) and read back:
    the documents with shard, bucket and place, ready for ``with_slots``."""
    placed = scattered(docs, **how)
    if path is None:
        return settled(placed, "shards")
    placed.write.parquet(path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def grown(key: Column, shard: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with one more shard: the new one, or where the record was."""
    held = F.greatest(*[_chance(key, i, seed) for i in range(shards)]) if shards > 1 else _chance(key, 0, seed)
    return F.when(_chance(key, shards, seed) >= held, F.lit(shards)).otherwise(shard)
