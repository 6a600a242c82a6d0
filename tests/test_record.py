"""Ranks, repeats and running figures against plain loops."""

import datetime
import random

from pyspark.sql import functions as F

from rankframe.operators import history as H
from rankframe.operators import record as R
from rankframe.operators import sites as S
from rankframe.operators.running import Measure, running

RESULTS = "job_id long, ordinal long, page int, position int, title string, url string, host string"


def random_results(seed, n=600):
    rng, rows = random.Random(seed), []
    for job in range(3):
        for ordinal in range(8):
            for page in range(1, rng.randint(2, 5)):
                places = sorted(rng.sample(range(1, 40), rng.randint(1, 8)))
                for p in places:
                    site = rng.choice(["a.com", "www.a.com", "b.com", ""])
                    url = f"https://{site}/{rng.randint(1, 3)}" + rng.choice(["", "/"]) if site and rng.random() < 0.7 else ""
                    rows.append((job, ordinal, page, p, f"t{rng.randint(1, 5)} ", url, site))
    rng.shuffle(rows)
    return rows


def ranked_by_loop(rows):
    out, rank, last = {}, 0, None
    for r in sorted(rows, key=lambda r: r[:4]):
        rank = max((rank if last == r[:2] else 0) + 1, r[3])
        last = r[:2]
        out[r[:4]] = rank
    return out


def test_cumulative_rank(spark):
    rows = random_results(1)
    got = R.cumulative_rank(spark.createDataFrame(rows, RESULTS)).collect()
    assert {(r.job_id, r.ordinal, r.page, r.position): r["rank"] for r in got} == ranked_by_loop(rows)


def test_cumulative_rank_over_slices_of_a_page(spark, monkeypatch):
    monkeypatch.setattr(R, "POSITIONS_PER_CHUNK", 3)
    rows = random_results(2)
    got = R.cumulative_rank(spark.createDataFrame(rows, RESULTS)).collect()
    assert {(r.job_id, r.ordinal, r.page, r.position): r["rank"] for r in got} == ranked_by_loop(rows)


def canonical(url):
    return url.removeprefix("https://").removeprefix("www.").removesuffix("/")


def test_first_seen_and_dropped(spark):
    rows = random_results(3)
    frame = spark.createDataFrame(rows, RESULTS)
    keys = {
        "url": lambda r: canonical(r[5]),
        "host": lambda r: canonical(r[5]).split("/")[0] if r[5] else r[6].removeprefix("www."),
        "text": lambda r: r[4].strip(),
        "": lambda r: "",
    }
    for by, key in keys.items():
        seen, want, dropped = set(), set(), {}
        for r in sorted(rows, key=lambda r: r[:4]):
            dropped.setdefault(r[0], 0)
            if not key(r) or (r[0], key(r)) not in seen:
                want.add(r[:4])
            else:
                dropped[r[0]] += 1
            seen.add((r[0], key(r)))
        got = R.first_seen(frame, F.lit(by))
        assert {tuple(r)[:4] for r in got.collect()} == want and got.count() == len(want)
        assert {r.job_id: r.dropped for r in R.dropped_counts(frame, F.lit(by)).collect()} == dropped


def test_rows_without_a_key_all_stay(spark):
    rows = [(1, 0, 1, 1, "a", "", ""), (1, 0, 1, 1, "b", "", ""), (1, 0, 1, 2, "c", "https://x.com/", "x.com"), (1, 1, 1, 1, "d", "https://x.com", "x.com")]
    frame = spark.createDataFrame(rows, RESULTS)
    assert sorted(r.title for r in R.first_seen(frame, F.lit("url")).collect()) == ["a", "b", "c"]
    # An address without a host in it leaves the recorded host to tell by.
    odd = spark.createDataFrame([(1, 0, 1, 1, "a", "https:///x", "y.com"), (1, 0, 1, 2, "b", "", "y.com"), (1, 0, 1, 3, "c", "https:///x", "")], RESULTS)
    assert sorted(r.title for r in R.first_seen(odd, F.lit("host")).collect()) == ["a", "c"]
    bare = spark.createDataFrame([(1, 0, 1, 1, "", "", "x.com"), (1, 0, 1, 1, "", "", "x.com")], RESULTS).withColumn("link", F.lit(""))
    sites = spark.createDataFrame([(1, 0, "x.com")], "job_id long, ordinal long, site string")
    assert S.list_indexed(bare, sites).count() == 2


def test_first_seen_after_an_earlier_run(spark):
    rows = random_results(4)
    frame = spark.createDataFrame(rows, RESULTS)
    whole = {tuple(r)[:4] for r in R.first_seen(frame, F.lit("url")).collect()}
    old, new = frame.where("ordinal < 4"), frame.where("ordinal >= 4")
    first = R.first_seen(old, F.lit("url"))
    rest = R.first_seen(new, F.lit("url"), R.seen_keys(old, F.lit("url")))
    assert {tuple(r)[:4] for r in first.unionByName(rest).collect()} == whole


def test_a_key_is_worked_out_once_per_row_and_use(spark):
    frame = spark.createDataFrame(random_results(8), RESULTS)

    def read(rows):
        return rows._jdf.queryExecution().optimizedPlan().toString().upper().count("REGEXP_REPLACE(")

    once = read(frame.select(R.seen_key(F.lit("url")).alias("key")))
    assert once and read(R.seen_keys(frame, F.lit("url"))) == once
    # For the first places, and again for the rows that stand in them.
    assert read(R.first_seen(frame, F.lit("url"))) == 2 * once
    places = R.first_places(frame, F.lit("url"))
    assert sorted(map(tuple, R.first_seen(frame, F.lit("url"), None, places).collect())) == sorted(
        map(tuple, R.first_seen(frame, F.lit("url")).collect())
    )


def test_counts_under_records_no_ranks(spark, tmp_path):
    from rankframe.plans import registry, views

    registry.load()
    day = datetime.datetime(1996, 1, 1)
    tables = {
        "nation": [(n, f"N{n}", n % 5) for n in range(5)],
        "orders": [(o, o % 5, "F", 1.0, day, "1-URGENT") for o in range(10)],
        "lineitem": [(o, o % 3, 1, n, float(n), 1.0, 0.0, 0.0, "A", "F", day) for o in range(10) for n in range(1, 5)],
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, views.DRIVER_TABLES[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.job_id, r.part): r.n for r in registry.run("counts_under", spark, str(tmp_path)).collect()}
    assert got[0, "queries"] == 2 and got[0, "results"] == 8 and got[0, "pages"] == 4 and sum(n for (_, part), n in got.items() if part == "seen")
    assert {name for _, folder, name in views._RECORDED if folder == str(tmp_path)} == {"arrivals"}


def test_running_measures_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, rng.randint(-9, 9)) for i in range(300)]
    frame = spark.createDataFrame(rows, "k string, at long, v int")
    measures = {
        "n": Measure("count"), "before": Measure("sum", F.col("v"), inclusive=False),
        "most": Measure("max", F.col("v")), "least_after": Measure("min", F.col("v"), inclusive=False),
    }
    for width in (1, 7, 1000):
        got = running(frame, ["k"], [F.floor(F.col("at") / width)], ["at"], measures).collect()
        assert len(got) == 300
        for r in got:
            upto = [v for k, i, v in rows if k == r.k and i <= r.at]
            assert (r.n, r.most) == (len(upto), max(upto))
            assert (r.before, r.least_after) == (sum(upto[:-1]), min(upto[:-1], default=None))
        two = running(frame, ["k"], [F.floor(F.col("at") / width)], ["at"], measures, coarser=3)
        assert sorted(map(str, two.collect())) == sorted(map(str, got))
        down = running(
            frame, ["k"], [F.floor(F.col("at") / width)], ["at"], {"next": Measure("min", F.col("at"), inclusive=False)}, descending=True
        )
        for r in down.collect():
            assert r.next == min((i for k, i, _ in rows if k == r.k and i > r.at), default=None)


def test_a_group_of_a_third_of_all_rows_is_split(spark):
    frame = spark.range(30000).select(F.when(F.col("id") < 10000, 0).otherwise(F.col("id")).alias("k"), "id")
    rows = running(frame, ["k"], [F.floor(F.col("id") / 100)], ["id"], {"n": Measure("count")})
    assert rows.where("k = 0").agg(F.max("n")).first()[0] == 10000
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "__chunk0_0" in plan and "hashpartitioning(k" in plan
    one = frame.where("k = 0").withColumns({"job_id": F.lit(1), "ordinal": F.lit(0), "page": F.lit(1), "position": F.col("id")})
    copies = one.withColumns({"url": F.lit("https://a.b/"), "host": F.lit(""), "title": F.lit("")})
    assert R.first_seen(copies, F.lit("url")).count() == 1


def test_fields_and_states(spark):
    rows = spark.createDataFrame([(["title"], "t", "u"), (None, "t", "u"), ([], "t", "u")], "f array<string>, title string, url string")
    rows = rows.withColumns({c: F.lit("x") for c in ("link", "host", "snippet", "display_path")})
    got = R.keep_fields(rows, "f").select("title", "url", "host").collect()
    assert [tuple(r) for r in got] == [("t", "", ""), ("t", "u", "x"), ("", "", "")]
    queries = spark.createDataFrame(
        [(1, 0, "pending", "", None), (1, 1, "failed", "e", None), (2, 0, "failed", "e", None)],
        "job_id long, ordinal long, state string, err string, settled_at timestamp",
    )
    jobs = spark.createDataFrame([(1, True), (2, False)], "job_id long, plan_ready boolean").withColumn(
        "finished_at", F.current_timestamp()
    )
    again, reopened, moved = R.retry_failed(queries, jobs, 1)
    assert moved.first().moved == 1
    assert {(r.job_id, r.ordinal): (r.state, r.err) for r in again.collect()} == {
        (1, 0): ("pending", ""), (1, 1): ("pending", ""), (2, 0): ("failed", "e"),
    }
    assert {r.job_id: r.finished_at is None for r in reopened.collect()} == {1: True, 2: False}
    assert R.pending(queries, jobs, 1).count() == 1 and R.pending(queries, jobs, 9).isEmpty()


def test_walk_extent(spark):
    rows = [
        (1, 0, 1, 10, 90, True), (1, 0, 2, 10, 10, True), (1, 0, 3, 10, 90, True),  # the bar on page 2 ends there
        (1, 1, 1, 10, 0, False), (1, 1, 2, 0, 0, False), (1, 1, 3, 5, 0, False),  # no bar never stops, no results do
        (1, 2, 1, 10, 90, True), (1, 2, 3, 10, 90, True),  # a gap
        (1, 3, 2, 10, 90, True), (1, 4, 1, 3, 0, True),  # no first page; a bar without more
    ]
    frame = spark.createDataFrame(rows, "job_id long, ordinal long, page int, n_results int, max_offset int, has_pagination boolean")
    got = {(r.ordinal, r.page) for r in S.walk_extent(frame).collect()}
    assert got == {(0, 1), (0, 2), (1, 1), (2, 1), (4, 1)}


def test_positions(spark):
    queries = spark.createDataFrame([(1, 0, "q"), (1, 1, "r")], "job_id long, ordinal long, text string")
    rows = [
        (1, 0, 1, 1, "", "https://other.com/", "other.com"), (1, 0, 1, 2, "", "", "notexample.com"), (1, 0, 2, 1, "", "", "shop.example.com"),
        (1, 0, 2, 2, "", "http://www.example.com/p/", "example.com"), (1, 1, 1, 1, "", "", "x.com"),
    ]
    results = R.cumulative_rank(spark.createDataFrame(rows, RESULTS))
    sites = spark.createDataFrame([(1, "example.com"), (1, "https://example.com/p"), (1, "none.org")], "job_id long, site string")
    got = {(r.ordinal, r.site): (r.found, r["rank"], r.page, r.how, r.scanned) for r in S.find_positions(queries, results, sites).collect()}
    assert got == {
        (0, "example.com"): (True, 3, 2, "host", 3), (0, "https://example.com/p"): (True, 4, 2, "url", 4), (0, "none.org"): (False, 0, 0, "none", 4),
        (1, "example.com"): (False, 0, 0, "none", 1), (1, "https://example.com/p"): (False, 0, 0, "none", 1), (1, "none.org"): (False, 0, 0, "none", 1),
    }


def test_positions_count_rows_and_follow_the_walk(spark):
    queries = spark.createDataFrame([(1, 0, "q")], "job_id long, ordinal long, text string")
    # Places jump (2, 9), and the bar of the second page ends the walk.
    rows = [(1, 0, 1, 2, "", "", "a.com"), (1, 0, 1, 9, "", "", "b.com"), (1, 0, 2, 4, "", "", "c.com"), (1, 0, 3, 1, "", "", "d.com")]
    pages = [(1, 0, 1, 2, 20, True), (1, 0, 2, 1, 10, True), (1, 0, 3, 1, 30, True)]
    pages = spark.createDataFrame(pages, "job_id long, ordinal long, page int, n_results int, max_offset int, has_pagination boolean")
    sites = spark.createDataFrame([(1, s) for s in ("b.com", "c.com", "d.com")], "job_id long, site string")
    found = S.find_positions(queries, spark.createDataFrame(rows, RESULTS), sites, pages).collect()
    assert {r.site: (r["rank"], r.page, r.scanned) for r in found} == {"b.com": (2, 1, 2), "c.com": (3, 2, 3), "d.com": (0, 0, 3)}


def test_index_verdicts(spark):
    rows = [(1, 0, 1, p, f"t{p}", "", "a.example.com") for p in range(1, 6)] + [(1, 1, 1, 1, "t", "", "x.com"), (1, 2, 2, 1, "t", "", "example.com")]
    results = spark.createDataFrame(rows, RESULTS)
    pages = results.select("job_id", "ordinal", "page").distinct()
    targets = spark.createDataFrame([(1, i, "example.com") for i in range(4)], "job_id long, ordinal long, site string")
    got = {r.ordinal: (r.indexed, r.hits, r.sample) for r in S.index_verdicts(pages, results, targets).collect()}
    # Queries 2 and 3 have no first page that was read, so they have no verdict.
    assert got == {0: (True, 5, ["t1", "t2", "t3"]), 1: (False, 0, [])}
    all_hits = S.index_verdicts(pages, results, targets, sample=9).where("ordinal = 0").first()
    assert all_hits.sample == [f"t{p}" for p in range(1, 6)]


def test_all_jobs_are_summed_up(spark):
    jobs = spark.range(120).selectExpr("id AS job_id", "concat('j', id) AS name", "timestamp_seconds(id) AS created_at", "'search' AS kind")
    queries = spark.range(120).selectExpr("id AS job_id", "0L AS ordinal", "'done' AS state")
    assert H.job_summaries(jobs, queries).count() == 120
    assert [r.job_id for r in H.job_summaries(jobs, queries, 2).collect()] == [119, 118]


def test_only_site(spark):
    rows = [("kling.test", ""), ("www.kling.test", ""), ("APP.kling.test.", ""), ("", "https://kling.test/x"), ("other.test", ""), ("notkling.test", "")]
    frame = spark.createDataFrame(rows, "host string, url string")
    assert S.only_site(frame, " HTTPS://www.Kling.test:1/x").count() == 4
    assert S.only_site(frame, "").count() == 6 and S.only_site(frame, "kling.test", kind="suggest").count() == 6


def test_pace(spark):
    queries = spark.createDataFrame(
        [(1, i, f"2024-01-01 00:{m:02d}:{s:02d}") for i, (m, s) in enumerate([(0, 0), (9, 0), (9, 15), (9, 30), (9, 45), (10, 0)])] + [(2, 0, "2024-01-01 00:09:00")],
        "job_id long, ordinal long, at string",
    ).withColumn("settled_at", F.col("at").cast("timestamp"))
    pages = spark.createDataFrame([(1, i, p) for i in range(6) for p in range(1, 3)], "job_id long, ordinal long, page int")
    got = {r.job_id: r for r in H.pace(queries, pages, F.lit("2024-01-01 00:10:00").cast("timestamp")).collect()}
    assert (got[1].settled, got[1].pages, got[1].over_seconds, got[1].per_minute, got[1].known) == (4, 8, 60.0, 4.0, True)
    assert got[2].known is False and got[2].per_minute == 0


def test_results_offer_only_what_their_job_asks_for(spark):
    rows = [(job, "https://www.a.example.com/p/", "a.example.com") for job in (1, 2, 3)]
    results = spark.createDataFrame(rows, "job_id long, url string, host string")
    sites = spark.createDataFrame([(1, "example.com"), (2, "https://a.example.com/p"), (4, "example.com")], "job_id long, site string")
    offered = S._offers(results, S._asked(sites), "job_id")
    assert sorted(map(tuple, offered.collect())) == [
        (1, "host", "a.example.com"), (1, "host", "com"), (1, "host", "example.com"), (2, "url", "a.example.com/p")
    ]
