"""Helpers that the operators of this folder share."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from rankframe.session import shared_folder

# A word is a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Folders that this process has written.
_WRITTEN: list[str] = []


def settled(frame: DataFrame, name: str, group_bytes: int = 0) -> DataFrame:
    """The frame written to the shared folder and read again: a cut in lineage
    that outlives any executor, and one evaluation for several readers. Rows of
    megabytes are written in groups of ``group_bytes``: a group is held whole by who
    writes it and who reads it, and its size is else first looked at after 100 rows."""
    spark = frame.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    _WRITTEN.append(folder)
    sizes = {"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1}
    frame.write.options(**(sizes if group_bytes else {})).parquet(f"{folder}/{name}")
    return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")


def cleared(spark: SparkSession) -> int:
    """Delete what this process has settled so far, and say how many tables that
    were. For when the results are written: frames returned earlier read them."""
    jvm, held = spark._jvm, len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return held


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")
