"""Running figures come out alike for groups that fit in a task and for larger ones."""

import math
import pathlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from rankframe.operators import running as N
from rankframe.operators.record import cumulative_rank
from rankframe.plans import views
from rankframe.plans.suggestions import _vocabulary
from rankframe.session import SETTINGS

ROWS = [(j, o, p, s) for j in (1, 2, None) for o in (1, 2, None) for p in (1, 2, 4, None) for s in (1, 3, 1030, None)]


def numbers(spark, descending):
    rows = spark.createDataFrame([(k, c, i) for k in ("a", "b", None) for c in (1, 2, None) for i in range(4 if k == "a" else 2)], "k string, c int, i int")
    measures = {
        "n": N.Measure("count"), "s": N.Measure("sum", F.col("i")), "before": N.Measure("max", F.col("i"), inclusive=False),
    }
    out = N.running(rows, ["k"], [F.col("c")], ["c", "i"], measures, descending)
    return sorted(map(str, out.collect()))


@pytest.mark.parametrize("descending", [False, True])
def test_small_and_large_groups_alike(spark, monkeypatch, descending):
    small = numbers(spark, descending)
    for size in (0, 8):
        monkeypatch.setattr(N, "ROWS_IN_TASK", size)
        assert numbers(spark, descending) == small


def test_ranks_alike(spark, monkeypatch):
    frame = spark.createDataFrame(ROWS, "job_id long, ordinal long, page int, position int")
    small = sorted(map(str, cumulative_rank(frame).collect()))
    assert len(small) == 4 * 9
    monkeypatch.setattr(N, "ROWS_IN_TASK", 0)
    assert sorted(map(str, cumulative_rank(frame).collect())) == small


def test_small_groups_are_shuffled_once(spark):
    frame = spark.createDataFrame(ROWS, "job_id long, ordinal long, page int, position int")
    ranked = cumulative_rank(frame.repartition(3))
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    # The rows by their query, and the count of each query's rows.
    assert len(dealt) <= 2, plan


def test_parts_are_small_enough_to_sort_in_memory(spark, tmp_path, monkeypatch):
    """Rows as recorded are read, and dealt out, in parts of 16 MB, row groups no larger."""
    for name in ("files.maxPartitionBytes", "adaptive.advisoryPartitionSizeInBytes"):
        assert SETTINGS[f"spark.sql.{name}"] == "16m"
    monkeypatch.setattr(views, "GROUP_BYTES", 64 * 1024)
    tables = views.Tables(spark, str(tmp_path))
    rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("s")).coalesce(1)
    tables._recorded("hashes", rows).count()
    held = views._RECORDED[(spark.sparkContext.applicationId, str(tmp_path), "hashes")]
    files = [pq.ParquetFile(f) for f in pathlib.Path(held).glob("*.parquet")]
    assert sum(f.num_row_groups for f in files) > 10


def test_a_vocabulary_is_counted_once_and_stored(spark, tmp_path):
    texts = ["ab ab a", "b, é", "", None, "ab"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    vocabulary = _vocabulary(views.Tables(spark, str(tmp_path)))
    # Every word with its mark, and every letter and mark of every word; a blank text is one mark twice.
    words = ["ab", "ab", "a", "b", ",", "é", "", "", "ab"]
    want = Counter(p for w in words for p in (f"▁{w}", *f"▁{w}"))
    got = {r.piece: round(math.exp(r.score) * 1e9) for r in vocabulary.collect()}
    assert got == dict(want)
    assert all("/vocabulary/" in file for file in vocabulary.inputFiles())
