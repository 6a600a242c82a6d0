"""Readers: query lists, captured pages and answers, the recorded tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.functions.urls import strip
from rankframe.operators.running import Measure, running
from rankframe.schemas import TABLES

CAPTURES = (
    "job_id bigint, ordinal bigint, query string, page int, status int, final_url string, origin string, html string"
)
ANSWERS = "key string, variant bigint, lang string, status int, body string"


def read_query_list(spark: SparkSession, path: str, allow_empty: bool = False) -> DataFrame:
    """(ordinal, text) of the lines of text files: trimmed, blank lines and
    lines that open with # dropped, repeats kept as separate work.

    The ordinal is dense in order of file, then line. Each file split numbers
    its own lines and is moved on by what the splits before it hold, so no task
    sees more than its split.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), "value"
    )
    # A byte order mark can only open a file.
    text = strip(F.regexp_replace("value", r"^\x{FEFF}", ""))
    kept = lines.select("__file", "__block", text.alias("text")).where((text != "") & ~text.startswith("#"))
    kept = kept.withColumn("__line", F.monotonically_increasing_id())
    splits = kept.groupBy("__file", "__block").agg(F.min("__line").alias("__first"), F.count(F.lit(1)).alias("__n"))
    moved = running(
        splits, [], [F.col("__file")], ["__block"], {"__before": Measure("sum", F.col("__n"), inclusive=False)}
    )
    out = kept.join(moved.select("__file", "__block", "__first", "__before"), ["__file", "__block"])
    listed = out.select((F.col("__line") - F.col("__first") + F.col("__before")).alias("ordinal"), "text")
    if not allow_empty and listed.isEmpty():
        raise ValueError(f"{path} holds no queries")
    return listed


def spread(rows: DataFrame) -> DataFrame:
    """The rows over every core, where the files they come from make fewer tasks
    than that (one file of one row group, say). For work that is heavy per row;
    select the columns first, since they are shuffled once."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def read_captures(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Captured pages, bodies of any length."""
    return spark.read.schema(CAPTURES).format(format).load(path)


def read_suggest_answers(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """Captured completion answers: (key, variant, lang, status, body)."""
    return spark.read.schema(ANSWERS).format(format).load(path)


def read_history(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The recorded tables under a folder, partitioned by job."""
    root = root.rstrip("/")
    return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in TABLES.items()}
