"""Recording a job's pages: ranks, repeats, kept fields, states of queries.

"First" always means lowest (ordinal, page, position) within the job.
"""

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.operators.expand import format_fault
from rankframe.functions.urls import canonical_host, canonical_url, let, strip
from rankframe.operators.running import by_size

QUERY = ["job_id", "ordinal"]
ROW = ["job_id", "ordinal", "page", "position"]
POSITIONS_PER_CHUNK = 1024
# The parts of a result a job can choose to keep, in file order.
RESULT_FIELDS = {
    "title": "title", "url": "url", "link": "link", "host": "host",
    "snippet": "snippet", "path": "display_path",
}
ALL_FIELDS = (*RESULT_FIELDS, "ads", "related")
KINDS = ("search", "position", "index", "suggest")
FILTERS = ("", "url", "host", "text")


def cumulative_rank(results: DataFrame, keys: Sequence[str] = QUERY) -> DataFrame:
    """Rank across a query's pages: one more than the row above, or the place
    the row itself says it stood at, whichever is further down.

    With ``i`` the count of rows so far that is ``i + max(0, max(position - i))``.
    A query that fits in a task is ranked by one sort of its rows. Of larger ones
    both figures are taken inside a page and carried over the query's pages, so
    the rows are shuffled once, by query and page, whatever a query holds.
    """
    asked = results.dropna(subset=list(keys))
    return by_size(asked, keys, lambda rows: _rank_whole(rows, keys), lambda rows: _rank_by_page(rows, keys))


def _rank_whole(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    upto = Window.partitionBy(*keys).orderBy("page", "position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = results.withColumn("__i", F.count(F.lit(1)).over(upto))
    placed = placed.withColumn("__ahead", F.max(F.col("position") - F.col("__i")).over(upto))
    rank = F.col("__i") + F.greatest(F.lit(0), F.col("__ahead"))
    # A row without a page or position takes its place in the count, and has no rank.
    return placed.where("page is not null and position is not null").select(*results.columns, rank.cast("long").alias("rank"))


def _rank_by_page(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    part = [*keys, "page", "__slice"]
    sliced = results.withColumn("__slice", F.floor(F.col("position") / POSITIONS_PER_CHUNK))
    inside = Window.partitionBy(*part).orderBy("position")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (
        Window.partitionBy(*keys).orderBy("page", "__slice").rowsBetween(Window.unboundedPreceding, -1)
    )

    def ahead(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__i", F.count(F.lit(1)).over(upto)).withColumn("__ahead", F.col("position") - F.col("__i"))

    pages = ahead(sliced.select(*part, "position")).groupBy(*part).agg(
        F.count(F.lit(1)).alias("__n"), F.max("__ahead").alias("__most")
    )
    carried = (
        pages.withColumn("__rows", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .withColumn("__furthest", F.max(F.col("__most") - F.col("__rows")).over(before))
        .select(*part, "__rows", "__furthest")
    )
    local = ahead(sliced).withColumn("__here", F.max("__ahead").over(upto))
    i = F.col("__i") + F.col("__rows")
    rank = i + F.greatest(F.lit(0), F.col("__furthest"), F.col("__here") - F.col("__rows"))
    return local.join(carried, part).select(*results.columns, rank.cast("long").alias("rank"))


def seen_key(by: Column | str) -> Column:
    """What repeats are told apart by under a job's filter; null keeps the row."""
    by = F.col(by) if isinstance(by, str) else by
    # An address without a host in it leaves the host that was recorded.
    host = let(canonical_host("url"), lambda own: F.when(own != "", own).otherwise(canonical_host("host")))
    key = (
        F.when(by == "url", F.when(strip("url") != "", canonical_url("url")))
        .when(by == "host", host)
        .when(by == "text", strip("title"))
    )
    return let(key, lambda k: F.when(k != "", k))


def _keyless(by: Column | str) -> Column:
    """Rows that have nothing a key could be made of; told without reading an address."""
    by = F.col(by) if isinstance(by, str) else by
    blank = {c: F.coalesce(strip(c), F.lit("")) == "" for c in ("url", "host", "title")}
    nothing = F.when(by == "url", blank["url"]).when(by == "host", blank["url"] & blank["host"]).when(by == "text", blank["title"])
    return F.coalesce(nothing, F.lit(True))


def place_key() -> Column:
    """(ordinal, page, position) as one number that orders alike; fixed in width,
    so its minimum is taken by hashing. Pages and positions are below 10 ** 9."""
    wide = F.col("ordinal").cast("decimal(19,0)") * F.lit(Decimal(10) ** 18).cast("decimal(19,0)")
    narrow = F.col("page").cast("long") * F.lit(10**9) + F.col("position")
    return (wide + narrow.cast("decimal(18,0)")).cast("decimal(38,0)")


def first_places(results: DataFrame, by: Column | str) -> DataFrame:
    """(job_id, key, at): the first place of each key, and with a null key the
    places of rows whose address reads as nothing after all. Rows with nothing to
    make a key of are left out. A key is worked out once per row, in one pass."""
    rest = results.where(~_keyless(by))
    # Exploding one value works the key out once, however often it is read.
    keyed = rest.select("job_id", place_key().alias("at"), F.explode(F.array(seen_key(by))).alias("key"))
    # A row without a key is a group of its place.
    own = F.when(F.col("key").isNull(), F.col("at")).alias("own")
    return keyed.groupBy("job_id", "key", own).agg(F.min("at").alias("at")).drop("own")


def first_seen(results: DataFrame, by: Column | str, seen: DataFrame | None = None, places: DataFrame | None = None) -> DataFrame:
    """Keep a job's first row of each key, and every row without a key.

    ``seen`` (job_id, key) holds what earlier runs kept. Only keys and places are
    grouped, and reduced before the shuffle, so a key of any number of copies is
    no hot spot; the rows come back by their place, which spreads evenly. Of rows
    with one key in one place one is kept. ``places`` are the rows' ``first_places``
    where they are at hand.
    """
    # Rows with nothing to make a key of stay as they are, neither sorted nor shuffled.
    alone, rest = results.where(_keyless(by)), results.where(~_keyless(by))
    first = first_places(results, by) if places is None else places
    first = first.select("job_id", F.col("key").alias("__first"), F.col("at").alias("__at"))
    if seen is not None:
        before = seen.select("job_id", F.col("key").alias("__first"))
        first = first.join(before, ["job_id", "__first"], "left_anti")
    found = rest.withColumn("__at", place_key()).join(first, ["job_id", "__at"])
    found = found.withColumn("__key", F.explode(F.array(seen_key(by)))).where(F.col("__key").eqNullSafe(F.col("__first")))
    twins = Window.partitionBy("job_id", "__at", "__first").orderBy("__at")
    found = found.withColumn("__copy", F.row_number().over(twins)).where("__copy = 1 or __first is null")
    return found.select(*results.columns).unionByName(alone)


def seen_keys(results: DataFrame, by: Column | str) -> DataFrame:
    """The (job_id, key) rows to remember for the next run."""
    # Exploded, so that the test for null does not work every key out again.
    keyed = results.select("job_id", F.explode(F.array(seen_key(by))).alias("key"))
    return keyed.where("key is not null").distinct()


def dropped_counts(results: DataFrame, by: Column | str, before: DataFrame | None = None) -> DataFrame:
    """Per job, how many rows the filter drops, added to ``before``
    (job_id, dropped). Counted per key first, which is reduced map-side."""
    keyed = results.select("job_id", seen_key(by).alias("key"))
    per_key = keyed.groupBy("job_id", "key").agg(F.count(F.lit(1)).alias("n"))
    now = per_key.groupBy("job_id").agg(
        F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("dropped")
    )
    if before is not None:
        now = now.unionByName(before.select("job_id", F.col("dropped").cast("long")))
    return now.groupBy("job_id").agg(F.sum("dropped").alias("dropped"))


def keeps(fields: Column | str, name: str) -> Column:
    """Whether a job's choice keeps a part; no choice (null) keeps all."""
    fields = F.col(fields) if isinstance(fields, str) else fields
    return F.coalesce(fields.isNull() | F.array_contains(fields, name), F.lit(True))


def keep_fields(results: DataFrame, fields: Column | str) -> DataFrame:
    """Blank the parts a job did not choose; rank, offtopic and similarity stay."""
    return results.withColumns(
        {c: F.when(keeps(fields, f), F.col(c)).otherwise(F.lit("")) for f, c in RESULT_FIELDS.items()}
    )


def keep_aside(rows: DataFrame, fields: Column | str, part: str) -> DataFrame:
    """Ads or related searches, where the job keeps that part."""
    return rows.where(keeps(fields, part))


def settle_queries(queries: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Write outcomes (job_id, ordinal, err, settled_at) onto their queries."""
    told = outcomes.select(
        *QUERY,
        F.coalesce("err", F.lit("")).alias("__err"),
        F.col("settled_at").alias("__at"),
        F.lit(True).alias("__told"),
    )
    state = F.when(F.col("__told"), F.when(F.col("__err") == "", "done").otherwise("failed"))
    return queries.join(told, QUERY, "left").select(
        *[c for c in queries.columns if c not in ("state", "err", "settled_at")],
        F.coalesce(state, F.col("state")).alias("state"),
        F.coalesce("__err", "err").alias("err"),
        F.coalesce("__at", "settled_at").alias("settled_at"),
    )


def pending(queries: DataFrame, jobs: DataFrame, job: int) -> DataFrame:
    """A job's untried queries in order; none while its plan is not ready."""
    ready = jobs.where((F.col("job_id") == job) & F.col("plan_ready")).select("job_id")
    waiting = queries.where((F.col("job_id") == job) & (F.col("state") == "pending"))
    return waiting.join(ready, "job_id", "left_semi").orderBy("ordinal")


def check_runnable(jobs: DataFrame, job: int) -> None:
    """Refuse a job whose plan is still being loaded."""
    if not jobs.where((F.col("job_id") == job) & ~F.col("plan_ready")).isEmpty():
        raise ValueError(f"the plan of job {job} is not ready")


def retry_failed(queries: DataFrame, jobs: DataFrame, job: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Failed queries of a job made pending again.

    Gives the queries, the jobs (the finish cleared where any query moved) and
    a one-row count of the queries moved.
    """
    failed = (F.col("job_id") == job) & (F.col("state") == "failed")
    moved = queries.where(failed).agg(F.count(F.lit(1)).alias("moved"))
    again = queries.select(
        *[c for c in queries.columns if c not in ("state", "err", "settled_at")],
        F.when(failed, "pending").otherwise(F.col("state")).alias("state"),
        F.when(failed, "").otherwise(F.col("err")).alias("err"),
        F.when(~failed, F.col("settled_at")).alias("settled_at"),
    )
    any_failed = queries.where(failed).select("job_id").distinct().withColumn("__moved", F.lit(True))
    reopened = jobs.join(any_failed, "job_id", "left").select(
        *[
            F.when(F.col("__moved").isNull(), F.col(c)).alias(c) if c == "finished_at" else F.col(c)
            for c in jobs.columns
        ]
    )
    return again, reopened, moved


def effective_filter() -> Column:
    """The filter a job form comes to: text by default for suggestions, none
    where the question is an index or a position."""
    asked = F.coalesce("unique_by", F.lit(""))
    texted = F.col("unique_by").isNull() | asked.isin("url", "host")
    return (
        F.when(F.col("kind").isin("index", "position"), "")
        .when((F.col("kind") == "suggest") & texted, "text")
        .otherwise(asked)
    )


def validate_jobs(forms: DataFrame) -> DataFrame:
    """Every fault of each job form at once, as an array of codes.

    Reads name, kind, unique_by (null = nothing said), target, pages,
    suggest_limit, fields (null = nothing chosen) and, where there is such a
    column, the formats of a search: the first one that cannot be read is named.
    """
    by = effective_filter()
    kind = F.coalesce("kind", F.lit(""))
    depth = F.when(kind.isin("index", "suggest"), F.lit(1)).otherwise(F.col("pages"))
    empty = F.coalesce(F.size("fields") == 0, F.lit(False))
    faults = {
        "name missing": F.coalesce(strip("name"), F.lit("")) == "",
        "kind not known": ~kind.isin(*KINDS),
        "filter not known": ~F.coalesce("unique_by", F.lit("")).isin(*FILTERS),
        "text filter outside suggestions": (by == "text") & (kind != "suggest"),
        "target missing": (kind == "position") & (F.coalesce(strip("target"), F.lit("")) == ""),
        "no page asked for": F.coalesce(depth, F.lit(0)) < 1,
        "limit below zero": (kind == "suggest") & (F.coalesce("suggest_limit", F.lit(0)) < 0),
        "no field kept": empty,
        "filter without its address": (by == "url") & ~empty & ~keeps("fields", "url"),
        "filter without its host": (by == "host") & ~empty & ~keeps("fields", "host"),
    }
    codes = [F.when(test, F.lit(code)) for code, test in faults.items()]
    if "formats" in forms.columns:
        # The rules of a format are those it is expanded by, so they are asked there.
        codes.append(F.when(kind == "search", F.concat(F.lit("format: "), format_fault("formats"))))
    return forms.withColumns({
        "filter": by,
        "depth": depth,
        "faults": F.array_compact(F.array(*codes)),
    })


def delete_job(tables: dict[str, DataFrame], job: int) -> dict[str, DataFrame]:
    """Every table without a job's rows (a partition drop on stored tables)."""
    return {name: rows.where(F.col("job_id") != job) for name, rows in tables.items()}


def counts_under(tables: dict[str, DataFrame], job: int | None = None) -> DataFrame:
    """How many rows each table holds under a job: (job_id, part, n)."""
    out = None
    for name, rows in tables.items():
        if job is not None:
            rows = rows.where(F.col("job_id") == job)
        one = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).select("job_id", F.lit(name).alias("part"), "n")
        out = one if out is None else out.unionByName(one)
    return out
