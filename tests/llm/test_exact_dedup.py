import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankframe.llm import exact_dedup as E

from . import cases


def brute(records):
    """(id, keep, size, kept) for each row; of repeats one is kept."""
    groups = defaultdict(list)
    for i, t in records:
        groups[t or ""].append(i)
    out = []
    for ids in groups.values():
        named = [i for i in ids if i is not None]
        keep, left = (max(named) if named else None), True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and left))
            left = left and i != keep
    return sorted(out, key=str)


def got(frame):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in frame.collect()], key=str)


def test_as_brute_force(spark):
    r = random.Random(4)
    records = [(i, r.choice(["a", "b", "c" * 50, None, "", f"t{i}"])) for i in range(500)]
    frame = spark.createDataFrame(records, "doc_id long, text string").repartition(7)
    assert got(E.groups_of_copies(frame)) == brute(records)
    hashes = {x.doc_id: x.digest.hex() for x in E.groups_of_copies(frame).collect()}
    from hashlib import sha256

    assert all(hashes[i] == sha256((t or "").encode()).hexdigest() for i, t in records)


def test_texts_that_share_a_digest_stay_apart(spark):
    records = [(i, f"{'ab'[i % 2]}{i % 6}") for i in range(60)] + [(100, "only")]
    weak = lambda text: F.substring(text, 1, 1).cast("binary")
    frame = spark.createDataFrame(records, "doc_id long, text string")
    assert got(E.groups_of_copies(frame, digest=weak)) == brute(records)
    kept = {r.doc_id for r in E.without_copies(frame, digest=weak).collect()}
    assert kept == {i for i, _, _, k in brute(records) if k}


def test_odd_rows(spark):
    docs = cases.odd(spark)
    records = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(E.groups_of_copies(docs)) == brute(records)
    stays = E.without_copies(docs)
    assert stays.columns == docs.columns
    out = stays.collect()
    assert len(out) == len({t or "" for _, t in records})
    assert sum(r.text is None for r in out) == 0  # of the blank ones the empty text has the larger id
    assert all(r["__text"] == 1 and r["key"] == [1] for r in out if r.doc_id is not None)


def test_nothing(spark):
    docs = cases.table(spark, [])
    assert E.groups_of_copies(docs).collect() == [] and E.without_copies(docs).collect() == []


def test_a_hot_text_leaves_a_task_as_one_row(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    assert got(E.groups_of_copies(frame))[0][1:3] == (3999, 4000)
    plan = E._combined(E._prepared(frame, "doc_id", "text", E.sha256), 4, lambda: [F.count(F.lit(1)).alias("n")], lambda: [F.sum("n")])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("partial_") == 2 and "Python" not in text and "Window" not in text


@pytest.mark.parametrize("salts", [1, 3])
def test_salts_change_nothing(spark, salts):
    records = [(i, f"t{i % 3}") for i in range(90)]
    assert got(E.groups_of_copies(spark.createDataFrame(records, "doc_id long, text string").repartition(5), salts=salts)) == brute(records)
