"""Site questions over result tables: positions, index verdicts, site filters.

"Is this host the site or below it" is asked as equality against the host's
suffixes, so every question is a hash join and never a product of two tables.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions.urls import (
    absolute_link,
    canonical_url,
    host_belongs_to,
    host_suffixes,
    is_engine_host,
    normalise_site,
    readable,
    site_of,
    split_site,
    strip,
    untranslated,
    url_host,
)
from rankframe.operators.record import POSITIONS_PER_CHUNK, QUERY, ROW
from rankframe.operators.running import Measure, firsts, running

SAMPLE = 3  # titles a verdict shows unless asked for more
RESULTS_PER_PAGE = 10


def _walked(pages: DataFrame, captures: DataFrame | None = None, **more: Measure) -> DataFrame:
    """Pages with ``__whole``, whether the walk takes them, and further running figures."""
    empty = F.col("n_results") == 0
    last = F.col("has_pagination") & (F.col("max_offset") <= (F.col("page") - 1) * RESULTS_PER_PAGE)
    walked = running(
        pages,
        QUERY,
        [F.floor(F.col("page") / POSITIONS_PER_CHUNK)],
        ["page"],
        {"__at": Measure("count"), "__ended": Measure("count", F.when(empty | last, 1), inclusive=False), **more},
        counted=captures,
    )
    whole = (F.col("__at") == F.col("page")) & (F.col("__ended") == 0) & ~empty
    return walked.withColumn("__whole", whole)


def walk_extent(pages: DataFrame, captures: DataFrame | None = None) -> DataFrame:
    """The pages a walk from page 1 takes: (keys, page, n_results, max_offset,
    has_pagination) up to where it stops.

    It stops before a page without results, after a page whose bar reaches no
    further, and where the capture has a gap. ``captures`` are what the pages were
    read from, one row each: they are counted in place of the pages, which are then read once.
    """
    return _walked(pages, captures).where("__whole").select(*pages.columns)


def _asked(sites: DataFrame) -> DataFrame:
    """Site questions with what they want: an address or a host."""
    want = split_site(strip("site"))
    asked = sites.where(strip("site") != "").withColumn("__want", want)
    page = F.col("__want.want_url") != ""
    return asked.select(
        *sites.columns,
        F.when(page, "url").otherwise("host").alias("__how"),
        # Never null, said so that joins need not look: see ``split_site``.
        F.coalesce(
            F.when(page, canonical_url("__want.want_url")).otherwise(F.col("__want.want_host")), F.lit("")
        ).alias("__wanted"),
    )


def _offers(results: DataFrame, asked: DataFrame, *kept: str) -> DataFrame:
    """What each result can answer to: its address, its host and every domain
    above it, each worked out only in jobs that ask for that kind."""
    kinds = asked.groupBy("job_id").agg(
        F.bool_or(F.col("__how") == "url").alias("__by_url"), F.bool_or(F.col("__how") == "host").alias("__by_host")
    )
    none = F.array().cast("array<string>")
    by_url = F.when(F.col("__by_url") & (F.col("url") != ""), canonical_url("url"))
    by_host = F.when(F.col("__by_host"), host_suffixes("host")).otherwise(none)
    # The address comes first, null where there is none, so the place tells the kind.
    offers = F.posexplode(F.concat(F.array(by_url), by_host)).alias("__kind", "__wanted")
    known = results.where("host is not null").join(kinds, "job_id")
    offered = known.select(*kept, offers).where("__wanted is not null")
    how = F.when(F.col("__kind") == 0, "url").otherwise("host")
    return offered.select(*kept, how.alias("__how"), "__wanted")


def find_positions(queries: DataFrame, results: DataFrame, sites: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Where each job's sites stand for each of its queries.

    Rows are counted as they are read, page after page: the count is the rank,
    and how many were read is ``scanned``. ``pages`` (see ``walk_extent``) leaves
    only the pages a walk takes; without it every page of ``results`` was read.
    ``sites`` is (job_id, site). A site not found answers rank 0.
    """
    page_key, lines = [*QUERY, "page"], results.select(*ROW, "url", "host")
    # A row's place on its page, and the rows of the pages before it, make its rank.
    inside = Window.partitionBy(*page_key).orderBy("position")
    placed = lines.withColumn("__place", F.row_number().over(inside))
    held = placed.groupBy(*page_key).agg(F.count(F.lit(1)).alias("__rows"))
    before = {"__before": Measure("sum", F.col("__rows"), inclusive=False)}
    if pages is None:
        walk = running(held, QUERY, [F.floor(F.col("page") / POSITIONS_PER_CHUNK)], ["page"], before)
    else:
        # The end of the walk is found in the pass that adds up the pages.
        shown = pages.select(*page_key, "n_results", "max_offset", "has_pagination").join(held, page_key, "left")
        walk = _walked(shown, **before).where(F.col("__whole") & F.col("__rows").isNotNull())
    walk = walk.select(*page_key, "__rows", F.coalesce("__before", F.lit(0)).alias("__before"))
    asked = _asked(sites)
    matched = _offers(placed, asked, *page_key, "__place").join(asked, ["job_id", "__how", "__wanted"])
    # The pages are folded into one row per query, which holds its first match of each site.
    first = matched.groupBy(*page_key, "site").agg(F.min(F.struct("__place", "__how")).alias("__hit"))
    found = first.join(walk, page_key).groupBy(*QUERY, "site").agg(
        F.min(F.struct((F.col("__before") + F.col("__hit.__place")).alias("rank"), "page", F.col("__hit.__how").alias("how"))).alias("__f")
    )
    found = found.select(*QUERY, "site", "__f.*")
    read = walk.groupBy(*QUERY).agg(F.sum("__rows").alias("__read"))
    rows = queries.select(*QUERY, F.col("text").alias("query")).join(asked.select("job_id", "site"), "job_id")
    hit = F.col("rank").isNotNull()
    return (
        rows.join(read, QUERY, "left")
        .join(found, [*QUERY, "site"], "left")
        .select(
            *QUERY,
            "query",
            "site",
            hit.alias("found"),
            F.coalesce("rank", F.lit(0)).alias("rank"),
            F.coalesce("page", F.lit(0)).alias("page"),
            F.coalesce("how", F.lit("none")).alias("how"),
            F.coalesce("rank", "__read", F.lit(0)).alias("scanned"),
        )
    )


def index_verdicts(pages: DataFrame, results: DataFrame, targets: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Whether each query's target is held, from its first page.

    ``targets`` is (job_id, ordinal, site). Only a page that was read answers:
    a query without page 1 in ``pages`` gives no verdict. All hits are counted;
    ``sample`` says how many titles are shown. A first page is a handful of
    rows, so a question and its page meet by the query alone.
    """
    asked = _asked(targets).join(pages.where(F.col("page") == 1).select(*QUERY), QUERY, "left_semi")
    first = results.where(F.col("page") == 1).select(*QUERY, "position", "title", "url", "host")
    by_url = (F.col("url") != "") & (canonical_url("url") == F.col("__wanted"))
    hit = F.when(F.col("__how") == "url", by_url).otherwise(host_belongs_to("host", F.col("__wanted")))
    seen = asked.join(first, QUERY, "left").withColumn("__hit", F.coalesce(hit, F.lit(False)))
    shown = F.array_sort(F.collect_list(F.when(F.col("__hit"), F.struct("position", "title"))))
    told = seen.groupBy(*QUERY, "site").agg(F.count_if("__hit").alias("hits"), F.slice(shown, 1, sample).alias("__sample"))
    return told.select(
        *QUERY,
        F.col("site").alias("target"),
        (F.col("hits") > 0).alias("indexed"),
        "hits",
        F.transform("__sample", lambda s: s["title"]).alias("sample"),
    )


def index_unread(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Results that may be a target page and carry no address yet."""
    asked = targets.withColumn("__want", split_site(strip("site"))).where(F.col("__want.want_url") != "")
    open_rows = results.where((F.col("url") == "") & (F.col("link") != ""))
    may_be = (F.col("host") == "") | host_belongs_to("host", F.col("__want.want_host"))
    return open_rows.join(asked, QUERY).where(may_be).select(*results.columns, "site")


def list_indexed(results: DataFrame, sites: DataFrame) -> DataFrame:
    """A site: query's results that are on the site (job_id, ordinal, site),
    each page once; a row with neither link nor title is kept."""
    want = sites.select(*QUERY, "site", normalise_site(strip("site")).alias("__want"))
    on_site = results.join(want, QUERY).where(host_belongs_to("host", F.col("__want"))).drop("__want")
    key = F.when(F.col("link") != "", F.col("link")).when(F.col("title") != "", F.col("title"))
    once = firsts(on_site.where(key.isNotNull()), [*QUERY, "site", key.alias("__k")], ["page", "position"])
    return once.unionByName(on_site.where(key.isNull()))


def only_site(rows: DataFrame, site: str, part: str = "results", kind: str = "search") -> DataFrame:
    """Rows on a site or below it; the host of the address where none is given.
    Suggestions and index parts are not filtered."""
    if part != "results" or kind in ("suggest", "index"):
        return rows
    want = site_of(F.lit(site))
    host = F.when(F.col("host") != "", F.col("host")).otherwise(url_host("url"))
    host = F.regexp_replace(F.lower(host), r"\.\z", "")
    return rows.where((want == "") | (host == want) | F.endswith(host, F.concat(F.lit("."), want)))


def resolve_from_lookup(results: DataFrame, lookups: DataFrame) -> DataFrame:
    """Fill addresses from captured answers of the redirector.

    ``results`` carries ``origin``; ``lookups`` is (link, status, location),
    one row per absolute link. Adds ``resolution``: '' for rows that needed
    none, else resolved, failed, or untried where no answer was captured.
    """
    needed = (F.col("url") == "") & (F.col("link") != "")
    # Only what needs an answer is joined: the rest has no link to meet by.
    settled = results.where(~needed).withColumn("resolution", F.lit(""))
    asked = results.where(needed).withColumn("__link", F.coalesce(absolute_link("origin", "link")["url"], F.col("link")))
    answers = lookups.select(F.col("link").alias("__link"), "status", "location")
    answered = asked.join(answers, "__link", "left")
    place = F.col("location")
    redirected = (F.col("status") >= 300) & (F.col("status") < 400) & readable(place)
    host = F.lower(url_host(place))
    own = is_engine_host(host) | host.endswith(".translate.goog")
    got = F.when(redirected, F.coalesce(untranslated(place), F.when(~own, place)))
    joined = absolute_link("origin", "link")["error"].isNull()
    told = (
        F.when(F.col("__got").isNotNull(), "resolved")
        .when(~joined | F.col("status").isNotNull(), "failed")
        .otherwise("untried")
    )
    found = answered.withColumn("__got", got).select(
        *[F.coalesce("__got", F.lit("")).alias("url") if c == "url" else F.col(c) for c in results.columns],
        told.alias("resolution"),
    )
    return settled.unionByName(found)


def resolve_report(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Links tried, resolved and failed per group."""
    state = F.col("resolution")
    return resolved.groupBy(*keys).agg(
        F.count_if(state.isin("resolved", "failed", "untried")).alias("attempted"),
        F.count_if(state == "resolved").alias("resolved"),
        F.count_if(state == "failed").alias("failed"),
    )
