"""The dealt operators over the driver's tables, and the SQL beside them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm import (
    clustering,
    exact_dedup,
    html_text,
    language_model,
    merkle,
    mixing,
    near_dedup,
    packing,
    personal_data,
    quality,
    secret_scan,
    sharding,
    substring_dedup,
)
from rankframe.llm.common import documents

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        QUERIES[name] = plan
        if sql is not None:
            ORACLE[name] = sql.strip()
        return plan

    return register


def word_tokenizer() -> str:
    """The vocabulary file the packing contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


@query("op1_near_dedup")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, folder))


@query("op2_personal_data")
def private(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(documents(spark, folder))


@query("op3_secret_scan")
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scanned(documents(spark, folder))


@query("op4_html_extraction")
def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(spark.read.parquet(f"{folder.rstrip('/')}/pages.parquet"))


@query("op5_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_documents(documents(spark, folder), word_tokenizer())


MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS w FROM per_source),
ordered AS (SELECT *, row_number() OVER (ORDER BY s * 2.0 / w, source) AS k FROM weighed),
held AS (
  SELECT *, CAST(coalesce(sum(s) OVER before, 0) AS BIGINT) AS c, CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS BIGINT) AS free
  FROM ordered WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT CAST(sum(s) AS BIGINT) FROM per_source) - 2.0::DOUBLE * c) / free AS level FROM held),
level AS (SELECT level FROM levels WHERE w * level <= 2.0::DOUBLE * s ORDER BY k LIMIT 1),
targets AS (
  SELECT source, s, least(w * (SELECT level FROM level), 2.0::DOUBLE * s) AS target FROM weighed),
rates AS (SELECT *, CASE WHEN s > 0 THEN target / s ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, s AS source_size, target,
  size * CAST(floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT)
    / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""


@query("op6_mixing", MIXING_SQL)
def mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.weighed(documents(spark, folder))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op7_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(documents(spark, folder))


@query("op8_sharding")
def shards(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("doc_id")
    rows = sharding.write_shards(documents(spark, folder)).select(
        "doc_id",
        sharding.size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "bucket",
        "place",
        sharding.grown(key, F.col("shard"), sharding.SHARDS).alias("grown_shard"),
    )
    return sharding.with_slots(rows).drop("bucket", "place")


@query("op9_substring_dedup")
def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.without_repeats(documents(spark, folder))


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op10_exact_dedup", EXACT_SQL)
def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup.groups_of_copies(documents(spark, folder))
    return rows.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def _clustering_sql() -> str:
    """Rounds are written out, one after the other: nearest centroid, then exact means."""
    near = "arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d"
    gap = "list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
kept AS MATERIALIZED (SELECT *, row_number() OVER () AS n FROM whole),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS cluster, v AS w FROM kept WHERE vec_id IS NOT NULL
  ORDER BY sha256('2:' || vec_id), v LIMIT 40)"""
    ]
    for n in range(6):
        parts.append(f"d{n} AS (SELECT n, {near} FROM (SELECT n, cluster, CAST({gap} AS BIGINT) AS d FROM kept, c{n}) GROUP BY n)")
        if n < 5:
            parts.append(
                f"""m{n} AS (SELECT cluster, list(m ORDER BY i) AS w FROM (
  SELECT cluster, i, CAST(floor_div AS BIGINT) AS m FROM (
    SELECT cluster, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
    FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept JOIN d{n} USING (n)) GROUP BY cluster, i)) GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{n}.w, c{n}.w) AS w FROM c{n} LEFT JOIN m{n} USING (cluster))"""
            )
    return (
        ",\n".join(parts)
        + """
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(w, ',')) AS centroid_sha256
FROM kept JOIN d5 USING (n) JOIN c5 USING (cluster)"""
    )


@query("op11_clustering", _clustering_sql())
def centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clustering.clustered(spark.read.parquet(f"{folder.rstrip('/')}/embeddings.parquet"))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bits = "list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS UBIGINT[])), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS UBIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), {codes}), lambda c, b: {bits}), 4294967295)"


def _merkle_sql(levels: int = 14, upper: int = 9) -> str:
    """Levels are written out; a tree that has come to one node passes it on."""
    field = "coalesce(CAST(strlen({0}) AS VARCHAR) || ':' || {0}, '-')"
    others = " || ".join(field.format(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
    crc = _crc32_sql("CAST(doc_id AS VARCHAR)")
    bent = f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    parts = [
        f"""
WITH leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id, source, sha256({others} || {field.format("text")}) AS leaf,
    sha256({others} || {field.format(f"({bent})")}) AS bent FROM documents),
l0 AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
n0 AS (SELECT tree, place, leaf AS h, n FROM l0)""",
        "f0 AS (SELECT k, tree, place, n, bent AS acc, '' AS proof FROM l0)",
    ]
    for i in range(levels + upper):
        if i == levels:
            parts.append(f"s{i} AS MATERIALIZED (SELECT tree, h AS subroot FROM n{i})")
            parts.append(f"n{i}_ AS MATERIALIZED (SELECT 0 AS tree, tree AS place, h, count(*) OVER () AS n FROM n{i})")
            parts.append(f"f{i}_ AS MATERIALIZED (SELECT k, 0 AS tree, tree AS place, (SELECT count(*) FROM n{i}) AS n, acc, proof FROM f{i})")
        own = "_" if i == levels else ""
        parts.append(
            f"""n{i + 1} AS MATERIALIZED (
  SELECT tree, place // 3 AS place, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE min(h) END AS h,
    CAST((n + 2) // 3 AS BIGINT) AS n FROM n{i}{own} GROUP BY tree, place // 3, n),
r{i} AS MATERIALIZED (
  SELECT f.*, CASE f.place % 3 WHEN 0 THEN '' WHEN 1 THEN a.h ELSE a.h || b.h END AS l,
    CASE f.place % 3 WHEN 0 THEN coalesce(b.h, '') || coalesce(c.h, '') WHEN 1 THEN coalesce(c.h, '') ELSE '' END AS r
  FROM f{i}{own} f LEFT JOIN n{i}{own} a ON a.tree = f.tree AND a.place = f.place - f.place % 3
  LEFT JOIN n{i}{own} b ON b.tree = f.tree AND b.place = f.place - f.place % 3 + 1
  LEFT JOIN n{i}{own} c ON c.tree = f.tree AND c.place = f.place - f.place % 3 + 2),
f{i + 1} AS MATERIALIZED (
  SELECT k, tree, place // 3 AS place, CAST((n + 2) // 3 AS BIGINT) AS n, CASE WHEN n > 1 THEN sha256(l || acc || r) ELSE acc END AS acc, proof || l || r AS proof FROM r{i})"""
        )
    return (
        ",\n".join(parts)
        + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = h AS verified
FROM l0 JOIN s{levels} USING (tree) JOIN (SELECT k, acc, proof FROM f{levels + upper}) USING (k), (SELECT h FROM n{levels + upper})"""
    )


@query("op12_merkle_manifest", _merkle_sql())
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampers = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    bent = F.when(tampers, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.audited(documents(spark, folder), lambda: {"text": bent})


@query("op13_lm_scoring")
def language_model_scores(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return language_model.scores(documents(spark, folder), held_out)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
