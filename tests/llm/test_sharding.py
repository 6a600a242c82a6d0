import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.llm import queries as Q
from rankframe.llm import sharding as S

from . import cases


def test_every_row_has_its_place(spark, tmp_path):
    docs = spark.createDataFrame([(i, cases.prose(3, i)) for i in range(3000)], "doc_id long, text string")
    written = S.write_shards(docs, str(tmp_path / "shards"), shards=5, bucket_bytes=2000)
    rows = S.with_slots(written).collect()
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())
    by_shard = Counter(r.shard for r in rows)
    assert len(by_shard) == 5 and max(by_shard.values()) < 1.3 * min(by_shard.values())
    for shard, n in by_shard.items():
        mine = sorted((r for r in rows if r.shard == shard), key=lambda r: r.slot)
        assert [r.slot for r in mine] == list(range(n))
        assert [r.doc_id for r in mine] != sorted(r.doc_id for r in mine)
    assert len({r.bucket for r in rows}) > S.LEAST_BUCKETS
    # The same rows in other partitions give the same places.
    again = S.with_slots(S.write_shards(docs.repartition(7), shards=5, bucket_bytes=2000)).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in again) == sorted((r.doc_id, r.shard, r.slot) for r in rows)


def test_one_more_shard_only_takes(spark):
    ids = spark.range(4000).withColumnRenamed("id", "doc_id")
    key = F.col("doc_id")
    rows = ids.select(S.shard_of(key, 16).alias("a"), S.grown(key, S.shard_of(key, 16), 16).alias("b"), S.shard_of(key, 17).alias("c")).collect()
    assert all(r.b == r.c and r.b in (r.a, 16) for r in rows)
    assert 100 < sum(r.b == 16 for r in rows) < 400


def test_the_query(spark):
    rows = Q.QUERIES["op8_sharding"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")


def test_odd_rows(spark):
    docs = cases.odd(spark)
    rows = S.with_slots(S.write_shards(docs)).collect()
    assert len(rows) == docs.count() and {"shard", "bucket", "place", "slot", *docs.columns} == set(rows[0].asDict())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert S.with_slots(S.write_shards(cases.table(spark, []))).collect() == []
    with pytest.raises(ValueError):
        S.scattered(docs.withColumn("Shard", F.lit(1)))


def spark_hash(*values):
    """Spark's xxhash64 over integers, longs and texts; nulls are passed over."""
    import struct

    import xxhash

    h = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v if isinstance(v, bytes) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(data, seed=h)
    return h - (1 << 64) if h >> 63 else h


def plain(records, shards, bucket_bytes, seed):
    """(id, text, shard, slot) by plain loops."""
    import json
    import math
    import struct

    four = lambda n: struct.pack("<i", n)
    by_shard = {}
    for i, text in records:
        shard = max((spark_hash(four(seed), four(n), i), n) for n in range(shards))[1]
        by_shard.setdefault(shard, []).append((i, text))
    out = []
    for shard, rows in by_shard.items():
        n = max(S.LEAST_BUCKETS, math.ceil(sum(len((t or "").encode()) + 1 for _, t in rows) / bucket_bytes))
        held = {}
        for i, text in rows:
            whole = json.dumps({c: v for c, v in (("c0", i), ("c1", text)) if v is not None}, separators=(",", ":"))
            held.setdefault(spark_hash(four(~seed), i, text) % n, []).append((spark_hash(whole), i, text))
        slot = 0
        for bucket in sorted(held):
            rows = sorted(held[bucket], key=lambda r: r[0])
            order = np.arange(len(rows))
            np.random.default_rng([seed, shard, bucket]).shuffle(order)
            for at in order:
                out.append((*rows[at][1:], shard, slot))
                slot += 1
    return sorted(out, key=str)


def test_shard_and_slot_as_a_plain_version(spark):
    r = random.Random(9)
    records = [(r.choice([None, *range(40)]), r.choice([None, "", "a b", f"text {n}"])) for n in range(400)]
    records = list(dict.fromkeys(records))
    frame = spark.createDataFrame(records, "doc_id long, text string")
    for parts in (1, 6):
        placed = S.with_slots(S.write_shards(frame.repartition(parts), shards=5, bucket_bytes=200, seed=77))
        got = sorted([(x.doc_id, x.text, x.shard, x.slot) for x in placed.collect()], key=str)
        assert got == plain(records, 5, 200, 77)


def test_equal_rows_are_spread_and_reruns_agree(spark):
    n = 20_000
    same = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), (F.col("id") % 50).alias("other"))
    docs = same.unionByName(spark.createDataFrame([(i, f"t{i}", i) for i in range(50)], same.schema))
    runs = []
    for parts in (1, 7):
        placed = S.with_slots(S.write_shards(docs.repartition(parts), bucket_bytes=1000)).cache()
        per_bucket = placed.groupBy("shard", "bucket").count().collect()
        assert sum(x["count"] for x in per_bucket) == n + 50
        hot = [x["count"] for x in per_bucket if x["count"] > 5]
        assert len(hot) >= 18 and max(hot) < 3000
        slots = placed.groupBy("shard").agg(F.min("slot"), F.max("slot"), F.countDistinct("slot"), F.count("slot")).collect()
        assert all(x[1] == 0 and x[2] + 1 == x[3] == x[4] for x in slots)
        runs.append(sorted([tuple(x) for x in placed.select("doc_id", "text", "other", "shard", "slot").collect()], key=str))
        placed.unpersist()
    assert runs[0] == runs[1]
