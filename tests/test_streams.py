"""A stream run in several batches comes to what the batch operators say."""

import pytest
from pyspark.sql import functions as F

from rankframe.operators import layouts as Y
from rankframe.operators import record as R
from rankframe.streaming import streams as W
from tests.test_judge import event_frame, random_events, rhythm_by_loop
from tests.test_record import RESULTS, random_results


def as_stream(spark, frame, folder, parts):
    """The frame's slices as files that arrive one after another."""
    for at, part in enumerate(parts):
        frame.where(part).coalesce(1).write.parquet(f"{folder}/{at}")
    return (
        spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
        .option("latestFirst", "false").parquet(str(folder))
    )


def run(flow):
    flow.trigger(availableNow=True).start().awaitTermination()


def test_first_seen(spark, tmp_path):
    frame = spark.createDataFrame(random_results(6), RESULTS)
    live = as_stream(spark, frame, tmp_path / "in", ["ordinal < 3", "ordinal between 3 and 5", "ordinal > 5"])
    kept = W.stream_first_seen(live, F.lit("url"))
    run(kept.writeStream.format("memory").queryName("kept").option("checkpointLocation", f"{tmp_path}/c"))

    def keys(rows):
        key = R.seen_key(F.lit("url"))
        return sorted(map(tuple, rows.select("job_id", F.coalesce(key, F.lit("")).alias("k")).collect()))

    assert keys(spark.table("kept")) == keys(R.first_seen(frame, F.lit("url")))


def test_record_over_batches_and_a_batch_done_again(spark, tmp_path):
    frame = spark.createDataFrame(random_results(7), RESULTS)
    for c in ("link", "snippet", "display_path"):
        frame = frame.withColumn(c, F.lit("x"))
    jobs = spark.createDataFrame([(j, "url", ["url"]) for j in range(3)], "job_id long, unique_by string, fields array<string>")
    record = W.record_batch(f"{tmp_path}/out", jobs)
    parts = [frame.where("ordinal < 4"), frame.where("ordinal >= 4")]
    record(parts[0], 0)
    record(parts[1], 1)
    record(parts[1], 1)  # a failure after the write: the batch comes again
    got = spark.read.parquet(f"{tmp_path}/out/results")
    want = R.first_seen(R.cumulative_rank(frame), F.lit("url"))
    assert sorted(map(tuple, got.select(*R.ROW, "rank", "url").collect())) == sorted(map(tuple, want.select(*R.ROW, "rank", "url").collect()))
    assert {r.title for r in got.select("title").collect()} == {""}
    # What is remembered of each batch are its own keys, worked out once.
    for number, part in enumerate(parts):
        seen = spark.read.parquet(f"{tmp_path}/out/seen/epoch={number}")
        assert sorted(map(tuple, seen.collect())) == sorted(map(tuple, R.seen_keys(part.where("job_id < 3"), F.lit("url")).collect()))


def test_rhythm(spark, tmp_path):
    events = random_events(2)
    frame = event_frame(spark, sorted(events, key=lambda e: (e[1], e[2])))
    cuts = sorted(e[1] for e in events)
    low, high = cuts[150], cuts[350]
    parts = [f"sec < {low}", f"sec >= {low} and sec < {high}", f"sec >= {high}"]
    live = as_stream(spark, frame, tmp_path / "in", parts)
    seen = {}

    def put(batch, number):
        seen.update({r.session: (r.answered, r.met, r.intervals, r.carried) for r in batch.collect()})

    run(W.stream_rhythm(live).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{tmp_path}/c"))
    assert seen == rhythm_by_loop(events)


def test_pace_and_in_flight(spark, tmp_path):
    rows = [(1, 0, 2), (1, 100, 1), (1, 290, 3), (2, 10, 1)]
    frame = spark.createDataFrame(rows, "job_id long, sec long, pages long").withColumn("settled_at", F.timestamp_seconds("sec"))
    live = as_stream(spark, frame, tmp_path / "in", ["sec < 50", "sec >= 50"])
    run(W.stream_pace(live).writeStream.outputMode("complete").format("memory").queryName("pace").option("checkpointLocation", f"{tmp_path}/c"))
    first = spark.table("pace").where("job_id = 1 and `from` = timestamp_seconds(0)").first()
    assert (first.moments, first.pages) == (3, 6)
    both = W.in_flight_counts(live.where("pages < 3"), live.where("pages >= 2"))
    run(both.writeStream.outputMode("complete").format("memory").queryName("flight").option("checkpointLocation", f"{tmp_path}/f"))
    assert {r.job_id: r.in_flight for r in spark.table("flight").collect()} == {1: 0, 2: 1}


def test_score_and_export(spark, tmp_path):
    frame = spark.createDataFrame([("coffee", "coffee maker"), ("coffee", "tea")], "key string, text string")
    live = as_stream(spark, frame, tmp_path / "in", ["true"])
    vectors = spark.createDataFrame([("coffee", [1.0, 0.0]), ("tea", [1.0, 1.0])], "phrase string, vector array<double>")
    scored = W.stream_score(live, vectors)
    run(scored.writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/c"))
    got = {r.text: (r.offtopic, r.similarity) for r in spark.table("scored").collect()}
    assert got["coffee maker"] == (False, None) and got["tea"][0] is True and got["tea"][1] == pytest.approx(2**-0.5)
    lines = W.stream_export(scored.withColumnRenamed("key", "query").withColumnRenamed("text", "title"), Y.Layout("completions", ("key", "similarity"), format=Y.JSONL))
    run(lines.writeStream.format("memory").queryName("lines").option("checkpointLocation", f"{tmp_path}/l"))
    assert '{"key":"coffee","similarity":null}' in {r.value for r in spark.table("lines").collect()}


def test_captures_are_recorded_with_all_their_parts(spark, tmp_path):
    from rankframe.sources.readers import CAPTURES
    from tests.test_pages import result

    unit = '<div id="tads"><div data-text-ad="1"><a data-pcu="https://s.com/p" href="/aclk"><h3>Ad</h3></a></div></div>'
    more = '<div id="botstuff"><a href="/search?q=more">x</a></div>'
    page = lambda *links: "".join(result(i, link) for i, link in enumerate(links))
    rows = [
        (1, 0, "q", 1, 200, "", "https://o", page("https://a.com/", "https://b.com/") + unit + more), (1, 0, "q", 2, 200, "", "https://o", page("https://a.com")),
        (1, 1, "r", 1, 200, "", "https://o", page("https://b.com/", "https://c.com/")), (2, 0, "s", 1, 403, "", "https://o", ""),
        (2, 1, "t", 1, 200, "", "https://o", page("https://a.com/") + unit + more),
    ]
    jobs = spark.createDataFrame([(1, "url", None), (2, "", ["title"])], "job_id long, unique_by string, fields array<string>")
    frame = spark.createDataFrame(rows, CAPTURES)
    record = W.record_captures(str(tmp_path), jobs)
    record(frame.where("job_id = 1 and ordinal = 0"), 0)
    for _ in range(2):  # a batch done again replaces what it wrote
        record(frame.where("not (job_id = 1 and ordinal = 0)"), 1)
    held = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    assert sorted((r.job_id, r.ordinal, r["rank"], r.url) for r in held("results").collect()) == [
        (1, 0, 1, "https://a.com/"), (1, 0, 2, "https://b.com/"), (1, 1, 2, "https://c.com/"), (2, 1, 1, ""),
    ]
    assert [(r.job_id, r.placement, r.title) for r in held("ads").collect()] == [(1, "top", "Ad")]
    assert [(r.job_id, r.query) for r in held("related").collect()] == [(1, "more")]
    assert sorted((r.job_id, r.ordinal, r.page) for r in held("pages").collect()) == [(1, 0, 1), (1, 0, 2), (1, 1, 1), (2, 1, 1)]
    assert {r.job_id: r.n for r in held("dropped").groupBy("job_id").agg(F.sum("dropped").alias("n")).collect()} == {1: 2, 2: 0}
    assert {(r.job_id, r.ordinal): r.err for r in held("outcomes").collect()} == {
        (1, 0): "", (1, 1): "", (2, 0): "page refused (class banned)", (2, 1): "",
    }
