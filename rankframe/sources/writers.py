"""Writers: the recorded tables, plans, and files of lines in a layout's form."""

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.operators.expand import expand_queries
from rankframe.operators.layouts import JSONL, Layout, distinct_layout, header_line, record_line
from rankframe.schemas import JOBS, TABLES
from rankframe.session import shared_folder

BOM = "﻿"


def write_history(tables: dict[str, DataFrame], root: str) -> None:
    """Write recorded tables, replacing only the partitions of their jobs.

    Rows of one job go to several tasks by query, and lie sorted by host where
    they have one, so a site's history skips most of a file.
    """
    root = root.rstrip("/")
    for name, rows in tables.items():
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
        if "ordinal" in shaped.columns:
            sort = ["job_id", "host"] if "host" in shaped.columns else ["job_id", "ordinal"]
            shaped = shaped.repartition("job_id", F.floor(F.col("ordinal") / 4096)).sortWithinPartitions(*sort)
        writer = shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("job_id").parquet(f"{root}/{name}")


def append_history(tables: dict[str, DataFrame], root: str) -> None:
    """Add rows to recorded tables."""
    root = root.rstrip("/")
    for name, rows in tables.items():
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].fields])
        shaped.write.mode("append").partitionBy("job_id").parquet(f"{root}/{name}")


PLANS = "job_id bigint, batch string, first bigint, upto bigint"


def _held(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def _cut_back(spark: SparkSession, root: str, job_id: int, first: int) -> None:
    """Take a job's queries from an ordinal on out again: what a load left that failed half way."""
    held = _held(spark, f"{root}/queries", TABLES["queries"]).where(F.col("job_id") == job_id)
    if held.where(F.col("ordinal") >= first).isEmpty():
        return
    kept = f"{shared_folder(spark).rstrip('/')}/plan-{uuid.uuid4().hex}"
    held.where(F.col("ordinal") < first).write.parquet(kept)
    # The partition goes as a whole, since one without rows would not be overwritten.
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/queries/job_id={job_id}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    append_history({"queries": spark.read.schema(TABLES["queries"]).parquet(kept)}, root)


def load_plan(listed: DataFrame, formats: Sequence[str], job: DataFrame, job_id: int, root: str, batch: str | None = None) -> None:
    """Write one batch of a job's plan from a list (ordinal, text), then the job as ready.

    ``job`` is one row of the jobs table. Ordinals go on from the batches before.
    The queries are written first, then the batch's row in the ledger (``plans``:
    job_id, batch, first, upto), then the job's row, so a batch counts once it is
    in the ledger. A load that failed before that is run again under the same
    name: what it left is taken out, and a batch that is in the ledger is not
    loaded twice. Without a name every load is a batch of its own.
    """
    spark: SparkSession = listed.sparkSession
    root = root.rstrip("/")
    ledger = _held(spark, f"{root}/plans", PLANS).where(F.col("job_id") == job_id)
    start, whole = ledger.agg(F.coalesce(F.max("upto"), F.lit(0)), F.coalesce(F.max(F.col("batch") == batch), F.lit(False))).first()
    if not whole:
        if not start:
            # A job of before there was a ledger: ready, so all of it counts.
            ready = _held(spark, f"{root}/jobs", TABLES["jobs"]).where((F.col("job_id") == job_id) & F.col("plan_ready"))
            if not ready.isEmpty():
                held = _held(spark, f"{root}/queries", TABLES["queries"]).where(F.col("job_id") == job_id)
                start = held.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
        _cut_back(spark, root, job_id, start)
        queries = expand_queries(listed, formats).select(
            F.lit(job_id).cast("long").alias("job_id"), (F.col("ordinal") + start).alias("ordinal"),
            F.col("query").alias("text"), F.lit("pending").alias("state"), F.lit("").alias("err"),
            F.lit(None).cast("timestamp").alias("settled_at"),
        )
        append_history({"queries": queries}, root)
        # Counted in what was written, so the plan is worked out once.
        written = _held(spark, f"{root}/queries", TABLES["queries"]).where((F.col("job_id") == job_id) & (F.col("ordinal") >= start))
        upto = written.agg(F.max("ordinal") + 1).first()[0]
        if upto is None:
            raise ValueError("the plan is empty")
        row = spark.createDataFrame([(job_id, batch or uuid.uuid4().hex, start, upto)], PLANS)
        row.coalesce(1).write.mode("append").parquet(f"{root}/plans")
    ready = job.select(*[F.lit(True).alias(f.name) if f.name == "plan_ready" else F.col(f.name) for f in JOBS.fields])
    write_history({"jobs": ready}, root)


def layout_lines(rows: DataFrame, layout: Layout, order: Sequence[str]) -> DataFrame:
    """(head, order…, line): the lines of a file and the keys they sort by.

    The header is one more row with the lowest key, so it lands once and first.
    """
    if layout.unique:
        rows = distinct_layout(rows, layout, order)
    lines = rows.select(F.lit(1).alias("__head"), *[F.col(o).alias(f"__{o}") for o in order], record_line(layout).alias("line"))
    if layout.format == JSONL or not (layout.header or layout.bom):
        return lines
    first = header_line(layout) if layout.header else ""
    nulls = [F.lit(None).cast(lines.schema[f"__{o}"].dataType).alias(f"__{o}") for o in order]
    opening = BOM + first if layout.bom else first
    head = rows.sparkSession.range(1).select(F.lit(0).alias("__head"), *nulls, F.lit(opening).alias("line"))
    return head.unionByName(lines)


def write_lines(rows: DataFrame, layout: Layout, order: Sequence[str], path: str) -> None:
    """Write rows as the files of one table: ordered, the parts in name order.

    Without a header a byte order mark has no line of its own and is put before
    the first record.
    """
    lines = layout_lines(rows, layout, order)
    sort = ["__head", *[f"__{o}" for o in order]]
    if layout.bom and not layout.header and layout.format != JSONL:
        lines = lines.where("__head = 1")
        least = lines.agg(F.min(F.struct(*sort))).scalar()
        mark = F.when(F.struct(*sort) == least, F.concat(F.lit(BOM), "line")).otherwise(F.col("line"))
        lines = lines.withColumn("line", mark)
    lines.orderBy(*sort).select("line").write.mode("overwrite").option("lineSep", layout.eol).text(path)
