"""The recorded tables. Keys are natural: job_id, ordinal, page, position."""

from pyspark.sql import types as T

JOBS = T.StructType([
    T.StructField("job_id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("finished_at", T.TimestampType()),
    T.StructField("pages", T.IntegerType()),
    T.StructField("country", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("unique_by", T.StringType()),
    T.StructField("plan_ready", T.BooleanType()),
    T.StructField("dropped", T.LongType()),
    T.StructField("target", T.StringType()),
    T.StructField("tries", T.IntegerType()),
    T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("device", T.StringType()),
    T.StructField("suggest_multiword", T.BooleanType()),
    T.StructField("suggest_limit", T.IntegerType()),
    T.StructField("checks_met", T.LongType()),
])
QUERIES = T.StructType([
    T.StructField("job_id", T.LongType(), False),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("err", T.StringType()),
    T.StructField("settled_at", T.TimestampType()),
])
PAGES = T.StructType([
    T.StructField("job_id", T.LongType(), False),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("page", T.IntegerType(), False),
    T.StructField("origin", T.StringType()),
])
RESULTS = T.StructType([
    T.StructField("job_id", T.LongType(), False),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("page", T.IntegerType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("rank", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("display_path", T.StringType()),
    T.StructField("offtopic", T.BooleanType()),
    T.StructField("similarity", T.DoubleType()),
])
ADS = T.StructType([
    T.StructField("job_id", T.LongType(), False),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("page", T.IntegerType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("placement", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("snippet", T.StringType()),
])
RELATED = T.StructType([
    T.StructField("job_id", T.LongType(), False),
    T.StructField("ordinal", T.LongType(), False),
    T.StructField("page", T.IntegerType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("query", T.StringType()),
])
SEEN = T.StructType([
    T.StructField("job_id", T.LongType(), False),
    T.StructField("key", T.StringType(), False),
])

TABLES = {
    "jobs": JOBS,
    "queries": QUERIES,
    "pages": PAGES,
    "results": RESULTS,
    "ads": ADS,
    "related": RELATED,
}
