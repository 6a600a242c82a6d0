"""Queries that go through the readers and writers: files are written to the
shared folder and read back, as a user's would be."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.operators import pages as P
from rankframe.operators import suggest as S
from rankframe.plans.flows import _folder
from rankframe.plans.pages import _KINDS, _raw
from rankframe.plans.registry import query
from rankframe.plans.suggestions import _answers
from rankframe.plans.views import Tables
from rankframe.schemas import JOBS, TABLES
from rankframe.sources import readers, writers


@query(
    "read_query_list",
    """WITH lines AS (
         SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)
       SELECT row_number() OVER (ORDER BY doc_id, place) - 1 AS ordinal, trim(line) AS text FROM lines
       WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%'""",
)
def read_query_list(t: Tables) -> DataFrame:
    """The documents as text files in order, read as one list of queries."""
    folder = _folder(t)
    t.documents.orderBy("doc_id").select("text").write.text(folder)
    return readers.read_query_list(t.spark, folder)


@query(
    "stored_history",
    """SELECT job_id, ordinal, page, position, rank, title, url, link, host, snippet, display_path, offtopic, round(similarity, 6) AS similarity
       FROM h_ranked""",
    history=True,
)
def stored_history(t: Tables) -> DataFrame:
    """All recorded tables written under a folder, the results read from there."""
    held = {"jobs": t.h_jobs, "queries": t.h_queries, "pages": t.h_pages, "results": t.h_ranked, "ads": t.h_ads, "related": t.h_related}
    whole = {
        name: rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
        for name, rows in held.items()
    }
    folder = _folder(t)
    writers.write_history(whole, folder)
    rows = readers.read_history(t.spark, folder)["results"]
    return rows.withColumn("similarity", F.round("similarity", 6))


@query(
    "stored_captures",
    """SELECT page_id AS ordinal, CASE k WHEN 1 THEN 'empty' WHEN 3 THEN 'wall' WHEN 4 THEN 'banned' WHEN 5 THEN 'http' WHEN 0 THEN 'shell'
         ELSE 'wall' END AS class FROM seen""",
    ctes=_KINDS,
)
def stored_captures(t: Tables) -> DataFrame:
    folder = _folder(t)
    rows = _raw(t).withColumnRenamed("page_id", "ordinal")
    rows.withColumns({"job_id": F.lit(1).cast("long"), "query": F.lit("q"), "page": F.lit(1), "origin": F.lit("")}).write.parquet(folder)
    return P.extract_serps(readers.read_captures(t.spark, folder)).select("ordinal", "class")


@query(
    "stored_answers",
    """SELECT 'key ' || p_partkey AS key, 0 AS position, p_name || ' groß' AS text FROM part WHERE p_partkey % 6 < 2
       UNION ALL SELECT 'key ' || p_partkey, 1, 'a & b <' || p_partkey || '>' FROM part WHERE p_partkey % 6 < 2""",
)
def stored_answers(t: Tables) -> DataFrame:
    folder = _folder(t)
    rows = _answers(t).withColumn("key", F.concat(F.lit("key "), F.col("answer").cast("string"))).drop("answer")
    rows.withColumns({"variant": F.lit(0).cast("long"), "lang": F.lit("de")}).write.parquet(folder)
    completions = S.parse_suggest_answers(readers.read_suggest_answers(t.spark, folder))[1]
    return completions.select("key", "position", "text")


@query(
    "loaded_plan",
    """SELECT p_partkey * 2 + k - 1 AS ordinal, p_name || ' ' || p_partkey || ' ' || k AS text, 'pending' AS state, true AS plan_ready
       FROM part, (SELECT unnest([1, 2]) AS k)""",
)
def loaded_plan(t: Tables) -> DataFrame:
    """A list loaded as a job's plan, then read from the history."""
    folder = _folder(t)
    listed = t.part.select(F.col("p_partkey").alias("ordinal"), F.concat_ws(" ", "p_name", "p_partkey").alias("text"))
    told = {"job_id": F.lit(7), "name": F.lit("plan"), "plan_ready": F.lit(False)}
    job = t.spark.range(1).select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in JOBS.fields])
    writers.load_plan(listed, ["{query} {num:1:2}"], job, 7, folder)
    jobs, queries = (t.spark.read.parquet(f"{folder}/{name}") for name in ("jobs", "queries"))
    return queries.join(jobs.select("job_id", "plan_ready"), "job_id").select("ordinal", "text", "state", "plan_ready")
