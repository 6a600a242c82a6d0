"""A search history seen in the driver's tables, in Spark and in SQL.

Both sides use the same expressions, so an operator's answer over the Spark
view can be laid beside plain SQL over the same parquet files.
"""

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.operators.record import QUERY
from rankframe.operators.running import numbered
from rankframe.session import shared_folder

IDS_PER_CHUNK = 65536
GROUP_BYTES = 16 * 2**20
LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

HISTORY_SQL = """
h_jobs AS (
  SELECT CAST(n_nationkey AS BIGINT) AS job_id, 'job ' || n_name AS name,
    TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(n_nationkey * 30 AS INTEGER)) AS created_at,
    CASE n_regionkey WHEN 1 THEN 'position' WHEN 2 THEN 'index' WHEN 3 THEN 'suggest' ELSE 'search' END AS kind,
    CASE n_regionkey WHEN 0 THEN 'url' WHEN 4 THEN 'host' WHEN 3 THEN 'text' ELSE '' END AS unique_by,
    CASE WHEN n_nationkey % 3 = 0 THEN 'site' || n_nationkey || '.example.com'
         WHEN n_nationkey % 3 = 1 THEN 'https://www.site' || n_nationkey || '.example.com/p/' || n_nationkey
         ELSE 'example.com' END AS site
  FROM nation),
h_queries AS (
  SELECT o_orderkey AS query_id, CAST(o_custkey % 25 AS BIGINT) AS job_id,
    o_orderkey AS ordinal,
    'query ' || o_orderkey AS text,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'failed' ELSE 'pending' END AS state,
    CASE WHEN o_orderstatus <> 'P' THEN ''
         WHEN o_orderpriority LIKE '1%' THEN 'search "query ' || o_orderkey || '": refused (class wall)'
         WHEN o_orderpriority LIKE '2%' THEN 'search "query ' || o_orderkey || '": HTTP 403 (class banned)'
         WHEN o_orderpriority LIKE '3%' THEN 'parse "query (class wall) ' || o_orderkey || '": no results (class shell)'
         ELSE 'dial timeout' END AS err,
    CASE WHEN o_orderstatus = 'O' THEN NULL
         ELSE o_orderdate + to_seconds(CAST(o_orderkey * 37 % 86400 AS INTEGER)) END AS settled_at
  FROM orders),
h_lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
  FROM lineitem),
h_results AS (
  SELECT q.job_id, q.ordinal, (rn - 1) // 3 + 1 AS page,
    (rn - 1) % 3 + 1 + CASE WHEN (l_orderkey + (rn - 1) // 3) % 4 = 0 THEN 5 ELSE 0 END AS position,
    rn AS arrival,
    'title ' || (l_partkey % 50) AS title,
    CASE l_returnflag WHEN 'A' THEN 'https://www.site' || (l_suppkey % 40) || '.example.com/p/' || (l_partkey % 50) || '/'
      WHEN 'R' THEN 'http://SITE' || (l_suppkey % 40) || '.example.com/p/' || (l_partkey % 50) ELSE '' END AS url,
    CASE WHEN l_returnflag = 'N' THEN '/goto?u=' || l_partkey ELSE '/link/' || (l_partkey % 20) END AS link,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN ''
      ELSE 'site' || (l_suppkey % 40) || '.example.com' END AS host,
    'snippet ' || CAST(l_quantity AS INTEGER) AS snippet, 'p › ' || (l_partkey % 50) AS display_path,
    l_discount > 0.08 AS offtopic,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax * 10 END AS similarity,
    CAST(l_quantity AS INTEGER) AS quantity
  FROM h_lines JOIN h_queries q ON q.query_id = l_orderkey),
h_ranked AS (
  SELECT *, arrival + greatest(0, max(position - arrival) OVER (PARTITION BY job_id, ordinal ORDER BY arrival)) AS rank
  FROM h_results),
h_pages AS (SELECT DISTINCT job_id, ordinal, page FROM h_results),
h_ads AS (
  SELECT job_id, ordinal, page, position,
    CASE quantity WHEN 1 THEN 'top' WHEN 2 THEN 'bottom' ELSE 'product' END AS placement, title, host, url, snippet
  FROM h_results WHERE quantity <= 4),
h_related AS (SELECT job_id, ordinal, page, position, title AS query FROM h_results WHERE quantity >= 49)
"""


# The driver's tables as written: naming the types saves a footer job per read.
DRIVER_TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


# Where a session has recorded a history: (application, folder, table) -> path.
_RECORDED: dict[tuple[str, str, str], str] = {}


class Tables:
    """The driver's tables under one folder, and the history seen in them.

    The history is *recorded*: arrivals and ranked results are written once per
    session to the cluster's shared folder and read from there, as any stored
    history would be. Every question asked of it is worked out anew.
    """

    def _recorded(self, name: str, rows: DataFrame) -> DataFrame:
        at = (self.spark.sparkContext.applicationId, self.folder, name)
        if at not in _RECORDED:
            path = f"{shared_folder(self.spark).rstrip('/')}/history-{uuid.uuid4().hex}/{name}"
            # Row groups are not cut between tasks, so they are kept small.
            rows.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
            _RECORDED[at] = path
        return self.spark.read.schema(rows.schema).parquet(_RECORDED[at])

    def recorded(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows written once per session, and read from there by whoever asks."""
        return self._recorded(name, rows)

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DRIVER_TABLES:
            raise AttributeError(name)
        return self.spark.read.schema(DRIVER_TABLES[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def h_jobs(self) -> DataFrame:
        n, region = F.col("n_nationkey"), F.col("n_regionkey")
        host = F.concat(F.lit("site"), n, F.lit(".example.com"))
        return self.nation.select(
            n.cast("long").alias("job_id"),
            F.concat(F.lit("job "), "n_name").alias("name"),
            F.expr("timestampadd(DAY, n_nationkey * 30, timestamp'1995-01-01 00:00:00')").alias("created_at"),
            F.when(region == 1, "position").when(region == 2, "index").when(region == 3, "suggest")
            .otherwise("search").alias("kind"),
            F.when(region == 0, "url").when(region == 4, "host").when(region == 3, "text")
            .otherwise("").alias("unique_by"),
            F.when(n % 3 == 0, host)
            .when(n % 3 == 1, F.concat(F.lit("https://www."), host, F.lit("/p/"), n))
            .otherwise("example.com").alias("site"),
        )

    @cached_property
    def h_queries(self) -> DataFrame:
        o, status = F.col("o_orderkey"), F.col("o_orderstatus")
        first = F.substring("o_orderpriority", 1, 1)
        err = (
            F.when(status != "P", "")
            .when(first == "1", F.concat(F.lit('search "query '), o, F.lit('": refused (class wall)')))
            .when(first == "2", F.concat(F.lit('search "query '), o, F.lit('": HTTP 403 (class banned)')))
            .when(first == "3", F.concat(F.lit('parse "query (class wall) '), o, F.lit('": no results (class shell)')))
            .otherwise("dial timeout")
        )
        moment = F.expr("timestampadd(SECOND, int(o_orderkey * 37 % 86400), cast(o_orderdate as timestamp))")
        return self.orders.select(
            o.alias("query_id"),
            (F.col("o_custkey") % 25).cast("long").alias("job_id"),
            o.alias("ordinal"),
            F.concat(F.lit("query "), o).alias("text"),
            F.when(status == "F", "done").when(status == "P", "failed").otherwise("pending").alias("state"),
            err.alias("err"),
            F.when(status != "O", moment).alias("settled_at"),
        )

    @cached_property
    def h_results(self) -> DataFrame:
        chunk = [F.col("l_linenumber"), F.floor(F.col("l_partkey") / IDS_PER_CHUNK)]
        at = F.col("arrival") - 1
        page = F.floor(at / 3)
        flag, place = F.col("l_returnflag"), F.col("l_partkey") % 50
        site = F.concat((F.col("l_suppkey") % 40).cast("string"), F.lit(".example.com"))
        jump = F.when((F.col("l_orderkey") + page) % 4 == 0, 5).otherwise(0)
        shown = [
            F.col("l_orderkey").alias("query_id"),
            (page + 1).alias("page"),
            (at % 3 + 1 + jump).alias("position"),
            "arrival",
            F.concat(F.lit("title "), place).alias("title"),
            F.when(flag == "A", F.concat(F.lit("https://www.site"), site, F.lit("/p/"), place, F.lit("/")))
            .when(flag == "R", F.concat(F.lit("http://SITE"), site, F.lit("/p/"), place))
            .otherwise("").alias("url"),
            F.when(flag == "N", F.concat(F.lit("/goto?u="), "l_partkey"))
            .otherwise(F.concat(F.lit("/link/"), F.col("l_partkey") % 20)).alias("link"),
            F.when((flag == "N") & (F.col("l_linestatus") == "O"), "")
            .otherwise(F.concat(F.lit("site"), site)).alias("host"),
            F.concat(F.lit("snippet "), F.col("l_quantity").cast("int")).alias("snippet"),
            F.concat(F.lit("p › "), place).alias("display_path"),
            (F.col("l_discount") > 0.08).alias("offtopic"),
            F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") * 10).alias("similarity"),
            F.col("l_quantity").cast("int").alias("quantity"),
        ]
        owners = self.h_queries.select("query_id", *QUERY)

        def owned(lines: DataFrame) -> DataFrame:
            return lines.select(*shown).join(owners, "query_id").drop("query_id")

        # The lines of an order are joined where they were numbered, without another shuffle.
        return self._recorded("arrivals", numbered(self.lineitem, ["l_orderkey"], chunk, LINE_ORDER, "arrival", then=owned))

    @cached_property
    def h_ranked(self) -> DataFrame:
        from rankframe.operators.record import cumulative_rank

        # Sorted by host, so a site's history skips most of each file.
        return self._recorded("results", cumulative_rank(self.h_results).sortWithinPartitions("host"))

    @cached_property
    def h_pages(self) -> DataFrame:
        return self.h_results.select(*QUERY, "page").distinct()

    @cached_property
    def h_ads(self) -> DataFrame:
        n = F.col("quantity")
        return self.h_results.where(n <= 4).select(
            *QUERY, "page", "position",
            F.when(n == 1, "top").when(n == 2, "bottom").otherwise("product").alias("placement"),
            "title", "host", "url", "snippet",
        )

    @cached_property
    def h_related(self) -> DataFrame:
        rows = self.h_results.where(F.col("quantity") >= 49)
        return rows.select(*QUERY, "page", "position", F.col("title").alias("query"))
