"""Queries that expand keys, read suggestion answers and judge suggestions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.functions import text as X
from rankframe.functions import vectors as V
from rankframe.operators import expand as E
from rankframe.operators import judge as J
from rankframe.operators import phrases as P
from rankframe.operators import record as R
from rankframe.operators import suggest as S
from rankframe.operators.running import numbered
from rankframe.plans.registry import query
from rankframe.plans.views import Tables
from rankframe.sources.readers import spread

FORMATS = ["{query}", "  ", "{qery} {num:1:3}", '"{QUERY}" {ABC:a:c:2}-{num:0:1}', "{query} {x}"]


@query(
    "expand_queries",
    """WITH abc AS (
         SELECT * FROM (VALUES (0,'a'),(1,'b'),(2,'c'),(3,'aa'),(4,'ab'),(5,'ac'),(6,'ba'),(7,'bb'),(8,'bc'),(9,'ca'),(10,'cb'),(11,'cc')) v(k, w)),
       made AS (
         SELECT p_partkey AS o, 0 AS f, 0 AS k, trim(p_name || ' ' || p_size) AS query FROM part
         UNION ALL SELECT p_partkey, 1, n - 1, p_name || ' ' || p_size || ' ' || n FROM part, (SELECT unnest([1, 2, 3]) AS n)
         UNION ALL SELECT p_partkey, 2, k * 2 + n, '"' || p_name || ' ' || p_size || '" ' || w || '-' || n
           FROM part, abc, (SELECT unnest([0, 1]) AS n)
         UNION ALL SELECT p_partkey, 3, 0, p_name || ' ' || p_size || ' {x}' FROM part),
       once AS (SELECT query, min(struct_pack(o := o, f := f, k := k)) AS place FROM made GROUP BY query)
       SELECT row_number() OVER (ORDER BY place) - 1 AS ordinal, query FROM once""",
)
def expand_queries(t: Tables) -> DataFrame:
    text = F.concat("p_name", F.lit(" "), "p_size")
    return E.expand_queries(t.part.select(F.col("p_partkey").alias("ordinal"), text.alias("text")), FORMATS)


@query(
    "query_list",
    """WITH lines AS (
         SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)
       SELECT row_number() OVER (ORDER BY doc_id, place) - 1 AS ordinal, trim(line) AS text FROM lines
       WHERE trim(line) <> '' AND trim(line) NOT LIKE '#%'""",
)
def query_list(t: Tables) -> DataFrame:
    """Every line of every document as one numbered list of queries."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    kept = lines.select("doc_id", "at", F.trim("line").alias("text")).where("text != '' and not startswith(text, '#')")
    chunk = [F.floor(F.col("doc_id") / 64)]
    return numbered(kept, [], chunk, ["doc_id", "at"], "n", coarser=4096).select((F.col("n") - 1).alias("ordinal"), "text")


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_VARIANTS = f"""
keys AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS key,
  CASE length(p_name) % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'fr-FR' WHEN 2 THEN 'PG' ELSE 'xx' END AS lang FROM part),
cut AS (SELECT key, lang, string_split(key, ' ') AS words, CASE lang WHEN 'de' THEN {_sql_list(S.ALPHABETS['de'])}
  WHEN 'fr-FR' THEN {_sql_list(S.ALPHABETS['fr'])} WHEN 'PG' THEN {_sql_list(S.ALPHABETS['pt'])}
  ELSE {_sql_list(S.DEFAULT_ALPHABET)} END AS letters FROM keys),
spread AS (SELECT *, unnest(letters) AS a, generate_subscripts(letters, 1) - 1 AS i, len(letters) AS n FROM cut),
asked AS (
  SELECT key, lang, 0 AS variant, key AS text, 1 AS cursor, '' AS letter, '' AS echo FROM cut
  UNION ALL SELECT key, lang, 1, key || ' ', 1, '', '' FROM cut
  UNION ALL SELECT key, lang, 2, ' ' || key, 1, '', '' FROM cut
  UNION ALL SELECT key, lang, 3 + i, key || ' ' || a, 1, a, lower(key || ' ' || a) FROM spread
  UNION ALL SELECT key, lang, 3 + n + i, key || a, 1, '', '' FROM spread
  UNION ALL SELECT key, lang, 3 + 2 * n + i, a || ' ' || key, 1, a, lower(a) FROM spread
  UNION ALL SELECT key, lang, 3 + 3 * n + i, a || key, 1, '', '' FROM spread
  UNION ALL SELECT key, lang, 3 + (3 + g) * n + i, array_to_string(words[1:g], ' ') || ' ' || a || ' ' || array_to_string(words[g + 1:], ' '),
      strlen(array_to_string(words[1:g], ' ')) + 2, a, lower(array_to_string(words[1:g], ' ') || ' ' || a)
    FROM (SELECT *, unnest(range(1, len(words))) AS g FROM spread))
"""


def _keys(t: Tables) -> DataFrame:
    n = F.length("p_name") % 4
    lang = F.when(n == 0, "de").when(n == 1, "fr-FR").when(n == 2, "PG").otherwise("xx")
    key = F.concat("p_name", F.lit(" "), F.lower("p_type"))
    return t.part.select(key.alias("key"), lang.alias("lang")).distinct()


@query(
    "suggest_variants",
    "SELECT key, lang, CAST(variant AS BIGINT) AS variant, text, CAST(cursor AS BIGINT) AS cursor, letter, echo FROM asked",
    history=False,
    ctes=_VARIANTS,
)
def suggest_variants(t: Tables) -> DataFrame:
    rows = S.suggest_variants(_keys(t), multiword=True)
    return rows.select(
        "key", "lang", F.col("variant").cast("long").alias("variant"), "text",
        F.col("cursor").cast("long").alias("cursor"), "letter", F.array_join("echo", " ").alias("echo"),
    )


@query(
    "suggest_variants_limited",
    "SELECT key, count(*) AS questions, max(text) AS last FROM asked WHERE variant < 50 GROUP BY key",
    ctes=_VARIANTS,
)
def suggest_variants_limited(t: Tables) -> DataFrame:
    rows = S.suggest_variants(_keys(t), multiword=True, limit=50)
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("questions"), F.max("text").alias("last"))


@query(
    "drop_echoes",
    """SELECT key, CAST(variant AS BIGINT) AS variant, completion FROM (
         SELECT *, CASE variant % 4 WHEN 0 THEN replace(text, 'r', 'R') WHEN 1 THEN text || ' kaufen' WHEN 2 THEN key || letter || ' x' ELSE key END AS completion
         FROM asked)
       WHERE NOT (letter <> '' AND NOT regexp_matches(letter, '^[0-9]$')
         AND NOT list_contains(CASE lang WHEN 'de' THEN CAST([] AS VARCHAR[]) ELSE ['a', 'i'] END, letter)
         AND (lower(trim(completion)) = echo OR starts_with(lower(trim(completion)), echo || ' ')))""",
    ctes=_VARIANTS,
)
def drop_echoes(t: Tables) -> DataFrame:
    v = F.col("variant") % 4
    made = (
        F.when(v == 0, F.replace("text", F.lit("r"), F.lit("R"))).when(v == 1, F.concat("text", F.lit(" kaufen")))
        .when(v == 2, F.concat("key", "letter", F.lit(" x"))).otherwise(F.col("key"))
    )
    rows = S.suggest_variants(_keys(t), multiword=True).withColumn("completion", made)
    return S.drop_echoes(rows, "completion").select("key", F.col("variant").cast("long").alias("variant"), "completion")


def _answers(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    listed = F.concat(
        F.lit("﻿)]}'\n[[[\""), "p_name", F.lit(" <b>gro\\u00df</b>\",0,[1]],[\"a &amp; b &lt;"), k,
        F.lit("&gt;\",1],[7,\"no\"],[\" <i></i> \"],{\"no\":1}],{\"q\":\"x\"}]"),
    )
    body = F.when(k % 6 == 5, F.concat(F.lit("<html>"), "p_name", F.lit("</html>"))).otherwise(listed)
    status = F.when(k % 6 == 2, 429).when(k % 6 == 3, 403).when(k % 6 == 4, 500).otherwise(200)
    return t.part.select(k.alias("answer"), status.alias("status"), body.alias("body"))


@query(
    "parse_suggest_answers",
    """SELECT p_partkey AS answer, 0 AS position, p_name || ' groß' AS text FROM part WHERE p_partkey % 6 < 2
       UNION ALL SELECT p_partkey, 1, 'a & b <' || p_partkey || '>' FROM part WHERE p_partkey % 6 < 2""",
)
def parse_suggest_answers(t: Tables) -> DataFrame:
    return S.parse_suggest_answers(_answers(t))[1].select("answer", "position", "text")


@query(
    "suggest_refusals",
    """SELECT CASE p_partkey % 6 WHEN 2 THEN 'wall' WHEN 3 THEN 'banned' WHEN 4 THEN 'http' WHEN 5 THEN 'wall' ELSE '' END AS class,
         count(*) AS answers FROM part GROUP BY 1""",
)
def suggest_refusals(t: Tables) -> DataFrame:
    read, _ = S.parse_suggest_answers(_answers(t))
    return read.groupBy("class").agg(F.count(F.lit(1)).alias("answers"))


@query(
    "parse_plain_answers",
    """SELECT c_custkey AS answer, 0 AS position, c_name AS text FROM customer
       UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer""",
)
def parse_plain_answers(t: Tables) -> DataFrame:
    body = F.concat(F.lit('["q",["'), "c_name", F.lit('","'), "c_mktsegment", F.lit('"],[],{}]'))
    answers = t.customer.select(F.col("c_custkey").alias("answer"), F.lit(200).alias("status"), body.alias("body"))
    return S.parse_suggest_answers(answers, plain=True)[1].select("answer", "position", "text")


_PROBES = """
probes AS (
  SELECT 'part ' || l_partkey AS key, l_suppkey % 7 AS variant, CAST(l_quantity AS INTEGER) AS position,
    'text ' || (CAST(l_quantity AS INTEGER) % 10) AS text,
    CASE WHEN l_tax = 0.08 AND l_discount = 0 THEN NULL ELSE l_returnflag <> 'R' END AS answered FROM lineitem),
states AS (
  SELECT key, CASE WHEN count(*) > count(answered) THEN 'pending' WHEN NOT bool_or(answered) THEN 'failed' ELSE 'done' END AS state
  FROM probes GROUP BY key)
"""


def _settled(t: Tables) -> tuple[DataFrame, DataFrame]:
    open_ = (F.col("l_tax") == 0.08) & (F.col("l_discount") == 0)
    n = F.col("l_quantity").cast("int")
    probes = t.lineitem.select(
        F.concat(F.lit("part "), "l_partkey").alias("key"),
        (F.col("l_suppkey") % 7).alias("variant"),
        n.alias("position"),
        F.concat(F.lit("text "), n % 10).alias("text"),
        F.when(~open_, F.col("l_returnflag") != "R").alias("answered"),
    )
    return S.settle_keys(probes, probes.where("answered"))


@query("settle_key_states", "SELECT key, state FROM states", ctes=_PROBES)
def settle_key_states(t: Tables) -> DataFrame:
    return _settled(t)[0]


@query(
    "settle_keys",
    """SELECT key, row_number() OVER (PARTITION BY key ORDER BY place) AS position, text FROM (
         SELECT key, text, min(struct_pack(v := variant, p := position)) AS place FROM probes WHERE answered GROUP BY key, text)
       WHERE key IN (SELECT key FROM states WHERE state = 'done')""",
    ctes=_PROBES,
)
def settle_keys(t: Tables) -> DataFrame:
    return _settled(t)[1]


_CUT = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> '')"


@query(
    "words",
    f"""SELECT doc_id, CAST(len(w) AS BIGINT) AS words,
          md5(replace(replace(replace(array_to_string(w, ' '), 'a', 'zh'), 'b', 'sch'), 'o', '')) AS digest
        FROM (SELECT doc_id, {_CUT} AS w FROM documents)""",
)
def words(t: Tables) -> DataFrame:
    # Three Latin letters written as Cyrillic ones come back as their spellings.
    cyrillic = F.translate(F.lower("text"), "abo", "жщь")
    rows = spread(t.documents.select("doc_id", "text")).select("doc_id", X.words(cyrillic).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("words"), F.md5(F.array_join("w", " ")).alias("digest"))


_PLAIN, _ACCENTED = "eeeeaaaacuuuiiioooonsu", "éèêëàâäáçùûüîïíôöóòñßú"
_STEM = "greatest(4, CAST(ceil(least(length(a), length(b)) * 2 / 3) AS INTEGER))"


@query(
    "same_word",
    f"""WITH cut AS (SELECT string_split_regex(lower(translate(lower(text), '{_ACCENTED}', '{_PLAIN}')), '[^a-z0-9]+') AS w FROM documents),
        pairs AS (SELECT unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM cut),
        counted AS (SELECT a, b, count(*) AS n FROM pairs WHERE a <> '' AND b <> '' GROUP BY a, b)
        SELECT a, b, n FROM counted WHERE a = b OR (least(length(a), length(b)) >= 4 AND (
          left(a, {_STEM}) = left(b, {_STEM})
          OR levenshtein(a, b) <= CASE WHEN least(length(a), length(b)) >= 7 THEN 2 ELSE 1 END))""",
)
def same_word(t: Tables) -> DataFrame:
    """Neighbouring words of the documents that are one word in two forms."""
    plain = F.translate(F.lower("text"), _ACCENTED, _PLAIN)
    rows = spread(t.documents.select("text")).select(F.split(plain, "[^a-z0-9]+").alias("w"))
    pairs = F.arrays_zip(
        F.slice("w", 1, F.size("w") - 1).alias("a"), F.slice("w", 2, F.size("w")).alias("b")
    )
    near = rows.where(F.size("w") > 1).select(F.explode(pairs).alias("p"))
    near = near.select(F.col("p")["a"].alias("a"), F.col("p")["b"].alias("b")).where("a != '' and b != ''")
    counted = near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(X.same_word("a", "b"))


_PAIRS = """
pairs AS (
  SELECT l_orderkey, l_linenumber, p_name AS key, CASE l_linenumber % 6
    WHEN 0 THEN p_name || ' ' || lower(p_type) WHEN 1 THEN replace(p_name, ' ', '')
    WHEN 2 THEN left(p_name, CAST(instr(p_name, ' ') - 2 AS INTEGER)) || ' sale'
    WHEN 3 THEN 'cheap ' || substr(p_name, instr(p_name, ' ') + 1) || 's'
    WHEN 4 THEN lower(p_type) || ' ' || lower(replace(p_brand, '#', ' '))
    ELSE 'how to ' || substr(p_name, 2) END AS text
  FROM lineitem JOIN part ON p_partkey = l_partkey)
"""


def _pairs(t: Tables) -> DataFrame:
    k, name, blank = F.col("l_linenumber") % 6, F.col("p_name"), F.instr("p_name", " ")
    text = (
        F.when(k == 0, F.concat(name, F.lit(" "), F.lower("p_type"))).when(k == 1, F.replace(name, F.lit(" "), F.lit("")))
        .when(k == 2, F.concat(F.substring(name, F.lit(1), blank - 2), F.lit(" sale")))
        .when(k == 3, F.concat(F.lit("cheap "), F.substring(name, blank + 1, F.length(name)), F.lit("s")))
        .when(k == 4, F.concat(F.lower("p_type"), F.lit(" "), F.lower(F.replace("p_brand", F.lit("#"), F.lit(" ")))))
        .otherwise(F.concat(F.lit("how to "), F.substring(name, F.lit(2), F.length(name))))
    )
    parts = t.part.select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_brand")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey").join(parts, "l_partkey")
    return rows.select("l_orderkey", "l_linenumber", name.alias("key"), text.alias("text"))


_JUDGED = _PAIRS + f""",
    once AS (SELECT key, text, count(*) AS n, row_number() OVER (ORDER BY key, text) AS id FROM pairs GROUP BY key, text),
    cut AS (SELECT id, string_split(key, ' ') AS k, string_split_regex(text, '[^a-z0-9]+') AS w FROM once),
    ab AS (SELECT id, a, unnest(w) AS b FROM (SELECT id, unnest(k) AS a, w FROM cut)),
    by_word AS (
      SELECT id, bool_or(a = b OR (least(length(a), length(b)) >= 4 AND (left(a, {_STEM}) = left(b, {_STEM})
          OR levenshtein(a, b) <= CASE WHEN least(length(a), length(b)) >= 7 THEN 2 ELSE 1 END))
        OR (length(b) >= 4 AND length(a) > length(b) AND contains(a, b))) AS related
      FROM ab GROUP BY id),
    kr AS (SELECT id, n, array_to_string(k[i:i + n - 1], '') AS run FROM (
      SELECT id, k, i, unnest(range(1, least(4, len(k) - i + 1) + 1)) AS n FROM (SELECT id, k, unnest(range(1, len(k) + 1)) AS i FROM cut))),
    wr AS (SELECT id, n, array_to_string(w[i:i + n - 1], '') AS run FROM (
      SELECT id, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS n FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM cut))),
    by_run AS (SELECT id, bool_or(kr.n > 1 OR wr.n > 1) AS related FROM kr JOIN wr USING (id, run) GROUP BY id)"""  # fmt: skip


@query(
    "related_to_key",
    """SELECT key, text, n AS pairs, coalesce(x.related, false) OR coalesce(y.related, false) AS related
        FROM once LEFT JOIN by_word x USING (id) LEFT JOIN by_run y USING (id)""",
    ctes=_JUDGED,
)
def related_to_key(t: Tables) -> DataFrame:
    """Each distinct suggestion judged once, with how many rows it stands for."""
    once = _pairs(t).groupBy("key", "text").agg(F.count(F.lit(1)).alias("pairs"))
    return J.mark_related(once)


def _vectors(t: Tables) -> DataFrame:
    """The vectors of the history's phrases by number, dealt over the whole table."""
    n = t.embeddings.count()
    named = t.embeddings.select(F.col("vec_id"), "embedding")
    queries = t.h_queries.select(F.col("text").alias("phrase"), (F.col("query_id") % n).alias("vec_id"))
    titles = t.h_results.select(F.col("title").alias("phrase")).distinct()
    titles = titles.withColumn("vec_id", F.substring("phrase", 7, 10).cast("long") * 37 % n)
    return queries.unionByName(titles).join(named, "vec_id").select("phrase", F.col("embedding").alias("vector"))


@query(
    "closeness",
    """WITH heads AS (SELECT label, min(vec_id) AS head FROM embeddings GROUP BY label)
       SELECT e.vec_id, h.head, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])), 6) AS similarity
       FROM embeddings e JOIN heads h USING (label) JOIN embeddings k ON k.vec_id = h.head""",
)
def closeness(t: Tables) -> DataFrame:
    heads = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("head"))
    pairs = t.embeddings.select("vec_id", "label").join(heads, "label").select("vec_id", "head")
    phrases = t.embeddings.select(F.col("vec_id").alias("phrase"), F.col("embedding").alias("vector"))
    scored = J.score_pairs(pairs, phrases, "head", "vec_id")
    return scored.select("vec_id", "head", F.round("similarity", 6).alias("similarity"))


@query(
    "quantise_vectors",
    """WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127 AS s FROM embeddings)
       SELECT vec_id, round(s, 9) AS scale, array_to_string(list_transform(v, lambda x: CAST(round(x / s) AS INTEGER)), ',') AS q FROM d""",
)
def quantise_vectors(t: Tables) -> DataFrame:
    rows = t.embeddings.select("vec_id", V.quantised("embedding").alias("r"))
    q = F.array_join(F.col("r.q").cast("array<string>"), ",")
    return rows.select("vec_id", F.round("r.scale", 9).alias("scale"), q.alias("q"))


@query(
    "dequantise_vectors",
    """WITH d AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_max(list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x))) / 127 AS s FROM embeddings),
       b AS (SELECT vec_id, v, list_transform(v, lambda x: round(x / s) * s) AS w FROM d)
       SELECT vec_id, round(list_cosine_similarity(v, w), 6) AS agreement FROM b""",
)
def dequantise_vectors(t: Tables) -> DataFrame:
    """How well each row's int8 form agrees with the row itself."""
    rows = t.embeddings.select("vec_id", "embedding", V.quantised("embedding").alias("r"))
    back = V.dequantised("r.scale", "r.q")
    return rows.select("vec_id", F.round(V.closeness("embedding", back), 6).alias("agreement"))


@query(
    "score_backfill",
    """SELECT r.job_id, r.ordinal, page, position, round(CASE WHEN r.similarity IS NOT NULL THEN r.similarity
           ELSE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) END, 6) AS similarity
       FROM h_results r LEFT JOIN embeddings a ON a.vec_id = r.ordinal % (SELECT count(*) FROM embeddings)
       LEFT JOIN embeddings b ON b.vec_id = CAST(substr(title, 7) AS BIGINT) * 37 % (SELECT count(*) FROM embeddings)""",
    history=True,
)
def score_backfill(t: Tables) -> DataFrame:
    rows = J.score_backfill(t.h_results, t.h_queries, _vectors(t))
    return rows.select(*R.ROW, F.round("similarity", 6).alias("similarity"))


def _suggestions(t: Tables) -> DataFrame:
    jobs = t.h_jobs.where("kind = 'suggest'").select("job_id")
    return t.h_results.join(jobs, "job_id")


_SUGGESTED = "FROM h_results JOIN h_jobs USING (job_id) WHERE kind = 'suggest'"
_FILTERS = {
    "none": "false",
    "words": "offtopic",
    "meaning": "offtopic OR coalesce(similarity < 0.54, false)",
}

for _mode, _rule in _FILTERS.items():

    @query(
        f"filter_suggestions_{_mode}",
        f"SELECT job_id, ordinal, page, position, similarity {_SUGGESTED} AND NOT ({_rule})",
        history=True,
    )
    def filter_suggestions(t: Tables, mode: str = _mode) -> DataFrame:
        return J.filter_suggestions(_suggestions(t), mode, "NaN").select(*R.ROW, "similarity")

    @query(
        f"filter_counts_{_mode}",
        f"SELECT job_id, count(*) AS total, count(*) FILTER (WHERE {_rule.replace('0.54', '0.3')}) AS cut {_SUGGESTED} GROUP BY job_id",
        history=True,
    )
    def filter_counts(t: Tables, mode: str = _mode) -> DataFrame:
        # Asked for 0.1 the threshold stands at its lowest, 0.30.
        return J.filter_counts(_suggestions(t), mode, 0.1)


@query(
    "score_state",
    """SELECT job_id, bool_or(similarity IS NOT NULL) AS has_scores, count(*) FILTER (WHERE similarity IS NULL) AS unscored
       FROM h_results GROUP BY job_id""",
    history=True,
)
def score_state(t: Tables) -> DataFrame:
    return J.score_state(t.h_results)


@query(
    "unscored_phrases",
    """SELECT DISTINCT phrase FROM (SELECT unnest([q.text, r.title]) AS phrase FROM h_results r
       JOIN h_queries q USING (job_id, ordinal) WHERE similarity IS NULL)""",
    history=True,
)
def unscored_phrases(t: Tables) -> DataFrame:
    return J.unscored_phrases(t.h_results, t.h_queries)


def _vocabulary(t: Tables) -> DataFrame:
    """Pieces of the documents: their words and their single letters, scored by
    how common they are, with a small vector made from each piece's hash."""
    marked = t.documents.select(P.normalise_phrase("text").alias("marked"))
    words = marked.select(F.explode(F.split(F.expr("substring(marked, 2)"), "▁")).alias("w"))
    # Letters are taken of each distinct word, not of every place where it stands.
    words = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    whole = F.concat(F.lit("▁"), "w")
    pieces = words.select("n", F.explode(F.concat(F.array(whole), F.split(whole, ""))).alias("piece"))
    counted = pieces.where("piece != ''").groupBy("piece").agg(F.sum("n").alias("n"))

    def component(i: int) -> Column:
        return (F.pmod(F.xxhash64("piece", F.lit(i)), F.lit(255)) - 127).cast("tinyint")

    made = counted.select(
        "piece",
        F.xxhash64("piece").alias("id"),
        F.ln(F.col("n") / F.lit(1e9)).alias("score"),
        F.lit(0.01).alias("scale"),
        F.array(*[component(i) for i in range(8)]).alias("q"),
    )
    # A vocabulary is stored: its readers do not go through the documents again.
    return t.recorded("vocabulary", made)


@query("tokenise_phrases")
def tokenise_phrases(t: Tables) -> DataFrame:
    phrases = t.benchmark.select(F.col("text").alias("phrase"))
    cut = P.tokenise_phrases(phrases, _vocabulary(t), unknown_id=0)
    return cut.select("phrase", F.size("tokens").alias("pieces"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))


@query("embed_phrases")
def embed_phrases(t: Tables) -> DataFrame:
    vocab = _vocabulary(t)
    phrases = t.benchmark.select(F.col("text").alias("phrase"))
    vectors = P.embed_phrases(P.tokenise_phrases(phrases, vocab, unknown_id=0), vocab)
    return vectors.select("phrase", F.array_join(F.transform("vector", lambda x: F.round(x, 6).cast("string")), ",").alias("vector"))


# A vocabulary of the phrases' words alone leaves one cut, which SQL can make too.
_FORCED = r"""
phrases AS (SELECT DISTINCT text AS phrase FROM benchmark),
cut AS (
  SELECT phrase, list_filter(string_split(trim(regexp_replace(regexp_replace(phrase, '([!-/:-@\[-`{-~])', ' \1 ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS words
  FROM phrases),
ids AS (SELECT phrase, list_transform(words, lambda w: CAST('0x' || substr(md5('▁' || w), 1, 15) AS BIGINT)) AS ids FROM cut),
sums AS (
  SELECT phrase, ids, list_sum(list_transform(ids, lambda i: i % 7 - 3)) * 0.01 AS a, list_sum(list_transform(ids, lambda i: i % 8 - 3)) * 0.01 AS b,
    list_sum(list_transform(ids, lambda i: i % 9 - 3)) * 0.01 AS c FROM ids)
"""


def _words_alone(t: Tables) -> DataFrame:
    marked = P.normalise_phrase("text")
    words = t.benchmark.select(F.explode(F.split(F.substring(marked, F.lit(2), F.length(marked)), "▁")).alias("w"))
    pieces = words.where("w != ''").select(F.concat(F.lit("▁"), "w").alias("piece")).distinct()
    id_ = F.conv(F.substring(F.md5("piece"), 1, 15), 16, 10).cast("long")
    return pieces.withColumn("id", id_).select(
        "piece", "id", F.lit(-1.0).alias("score"), F.lit(0.01).alias("scale"),
        F.array(*[(F.col("id") % n - 3).cast("tinyint") for n in (7, 8, 9)]).alias("q"),
    )


@query("tokenise_words", "SELECT phrase, len(ids) AS pieces, array_to_string(ids, ',') AS tokens FROM ids", ctes=_FORCED)
def tokenise_words(t: Tables) -> DataFrame:
    cut = P.tokenise_phrases(t.benchmark.select(F.col("text").alias("phrase")), _words_alone(t), unknown_id=0)
    return cut.select("phrase", F.size("tokens").cast("long").alias("pieces"), F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))


@query(
    "embed_words",
    """SELECT phrase, round(a / sqrt(a * a + b * b + c * c), 6) + 0.0 AS a, round(b / sqrt(a * a + b * b + c * c), 6) + 0.0 AS b,
         round(c / sqrt(a * a + b * b + c * c), 6) + 0.0 AS c FROM sums""",
    ctes=_FORCED,
)
def embed_words(t: Tables) -> DataFrame:
    vocab = _words_alone(t)
    tokens = P.tokenise_phrases(t.benchmark.select(F.col("text").alias("phrase")), vocab, unknown_id=0)
    vector = P.embed_phrases(tokens, vocab)
    return vector.select("phrase", *[(F.round(F.col("vector")[i], 6) + F.lit(0.0)).alias(n) for i, n in enumerate("abc")])
