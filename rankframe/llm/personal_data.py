"""Personal data by bootstrapped contextual extraction. Built-in functions only.

Base spans (email, ip, card, phone) come from fixed patterns and always stay.
They seed a graph of lexical patterns (the words around a mention) and instances
(what is mentioned): a pattern's confidence is the score of its instances, an
unknown instance's score what its patterns make likely, in turns. Candidates that
look like identifiers and stand in a pattern of high confidence are added as
spans of the kind ``context``.

A candidate is a word with a digit or an at sign, or up to six neighbouring groups
of digits and capitals together (`020 7946 0958`, `(555) 123-4567`); a group of over
nine characters stands alone. The words around come from the text itself, ``AROUND``
characters and three matches to either side; words with a digit or an at sign are
passed over there, so that identifiers side by side have the same words around.

A match of a fixed pattern never starts inside a run that an earlier start has
taken up, which the look-behinds and possessive quantifiers say, so texts are
read in time proportional to their length. Places are counted from the pieces
between the matches, in two steps, so that many matches stay cheap.

Defined results: a null text counts as empty and has no spans; texts of any
length are read whole; rows that repeat id and text are judged alike, each with
its own row; a null id is carried along; an empty table gives no rows; further
columns are left alone.
"""

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import settled

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns of the contract, written to match only where a match may start.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![0-9]|[\x20-][0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# Candidates: groups of digits and capitals, or one word with a digit or an at sign;
# and how the core of one is cut out, with a bracket where it holds the first digits.
_GROUP = r"[0-9][0-9A-Z()./-]{0,8}+(?![0-9A-Z()./-])"
TOKEN = (
    r"(?<![^\x20\x09-\x0D])(?:"
    rf"[(+A-Z]{{0,4}}+{_GROUP}(?:\x20(?:[A-Z]{{4}}\x20)?[(A-Z]{{0,4}}+{_GROUP}){{1,5}}+[^\x20\x09-\x0D]*+"
    r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
LEAD, TRAIL = r"^(?:(?!\([0-9]++\))[^A-Za-z0-9@+])*+", r"(?<![^A-Za-z0-9])[^A-Za-z0-9]++$"
AROUND, NEIGHBOURS, CHUNK = 64, 3, 512
ROUNDS, CONFIDENCE, LEAST_SEEDS, IDENTIFIER = 3, 0.8, 3, (6, 64)
SPAN = "struct<start:bigint,end:bigint,value:string,before:string,after:string>"


def _pieces(found: str, gaps: str) -> Column:
    """Matches with what lies around each: gap and match lengths, value, before, after."""
    n = F.size(found)
    none, edge = F.lit(""), F.lit(AROUND)
    tails, heads = F.transform(gaps, lambda g: F.right(g, edge)), F.transform(gaps, lambda g: F.left(g, edge))

    def moved(array: Column | str, by: int) -> Column:
        """For each match the array's entry so many places on (or back)."""
        if by < 0:
            whole = F.concat(F.array_repeat(none, -by), F.slice(array, F.lit(1), n))
            return F.slice(whole, F.lit(1), n)
        return F.slice(F.concat(F.slice(array, F.lit(by + 1), n), F.array_repeat(none, by)), F.lit(1), n)

    sides = {f"b{i}": moved(tails, -i) for i in range(NEIGHBOURS + 1)} | {f"a{i}": moved(heads, i + 1) for i in range(NEIGHBOURS + 1)}
    sides |= {f"p{i}": moved(found, -i) for i in range(1, NEIGHBOURS + 1)} | {f"q{i}": moved(found, i) for i in range(1, NEIGHBOURS + 1)}
    every = F.arrays_zip(
        F.transform(gaps, lambda g: F.char_length(g)).alias("gap"), F.col(found).alias("value"), *[c.alias(name) for name, c in sides.items()]
    )

    def piece(x: Column) -> Column:
        before, after = [x["b0"]], [x["a0"]]
        for i in range(1, NEIGHBOURS + 1):
            before = [x[f"b{i}"], x[f"p{i}"], *before]
            after = [*after, x[f"q{i}"], x[f"a{i}"]]
        return F.struct(
            x["gap"].alias("gap"), F.char_length(x["value"]).alias("len"), x["value"].alias("value"),
            F.right(F.concat(*before), edge).alias("before"), F.left(F.concat(*after), edge).alias("after"),
        )

    # The gap after the last match has no match of its own.
    return F.transform(F.slice(every, F.lit(1), n), piece)


def _span(at: Column, p: Column) -> Column:
    start = at + p["gap"]
    return F.struct(start.alias("start"), (start + p["len"]).alias("end"), *[p[c].alias(c) for c in ("value", "before", "after")])


def _nothing() -> Column:
    return F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))


def _placed(pieces: Column) -> Column:
    """Pieces to spans: places within chunks first, then the chunks' own places."""

    def step(acc: Column, p: Column) -> Column:
        spans = F.concat(acc["out"], F.array(_span(acc["at"], p)))
        return F.struct((acc["at"] + p["gap"] + p["len"]).alias("at"), spans.alias("out"))

    def shifted(acc: Column, c: Column) -> Column:
        moved = F.transform(
            c["out"],
            lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), *[s[f].alias(f) for f in ("value", "before", "after")]),
        )
        return F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / CHUNK).cast("int")),
        lambda k: F.aggregate(F.slice(pieces, k * CHUNK + 1, F.lit(CHUNK)), _nothing(), step),
    )
    return F.aggregate(chunks, _nothing(), shifted)["out"]


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    digits = F.regexp_replace(value, r"[^0-9]+", "")
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def _spans_of(docs: DataFrame) -> DataFrame:
    """(id, text) to (id, mark, email, ip, card, phone, token): arrays of spans."""
    text = F.coalesce("text", F.lit(""))
    hints = {"email": text.contains("@"), "phone": text.contains("+")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "token": TOKEN}
    none = F.array().cast("array<string>")
    cut = docs.select(
        "id",
        F.xxhash64(text).alias("mark"),
        *[
            F.when(hints.get(k, text.rlike("[0-9@]")), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"{k}_found")
            for k, p in patterns.items()
        ],
        text.alias("text"),
    )
    split = cut.select(
        "id", "mark", *[f"{k}_found" for k in patterns],
        *[F.when(F.size(f"{k}_found") > 0, F.split("text", p, -1)).otherwise(none).alias(f"{k}_gaps") for k, p in patterns.items()],
    )
    pieces = split.select("id", "mark", *[_pieces(f"{k}_found", f"{k}_gaps").alias(k) for k in patterns])
    empty = F.array().cast(f"array<{SPAN}>")
    placed = pieces.select("id", "mark", *[F.when(F.size(k) > 0, _placed(F.col(k))).otherwise(empty).alias(k) for k in patterns])
    return placed.select(
        "id", "mark", "token", *[F.filter(k, partial(_valid, k)).alias(k) for k in KINDS]
    )


def _words(side: Column) -> Column:
    """The words of what lies on one side, without those that may be identifiers."""
    return F.filter(F.split(F.lower(side), r"[\x20\x09-\x0D]+"), lambda w: (w != "") & ~w.rlike("[0-9@]"))


def _patterns(before: Column, after: Column) -> Column:
    """Two patterns: the two words before, and one word on either side."""
    left, right = _words(before), _words(after)
    one, two = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2))
    next_ = F.try_element_at(right, F.lit(1))
    return F.filter(F.array(F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _ "), next_)), lambda p: p.isNotNull())


def _instance(value: Column) -> Column:
    """What is mentioned, however it is grouped."""
    lower = F.lower(value)
    return F.when(lower.rlike("[a-z@]"), lower).otherwise(F.regexp_replace(lower, r"[\x20()-]+", ""))


def confident(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, least_seeds: int = LEAST_SEEDS) -> DataFrame:
    """Edges (pattern, instance, seed), each pair once, to the patterns of high
    confidence. Scores are rounded, so that the order of a sum decides nothing."""
    score = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.lit(0.0))
    scored = edges.withColumn("score", score)
    for n in range(rounds):
        patterns = scored.groupBy("pattern").agg(
            F.round(F.sum("score") / (F.count(F.lit(1)) + 1), 9).alias("confidence"), F.count(F.when(F.col("score") > 0.5, 1)).alias("known")
        )
        patterns = settled(patterns.where("confidence > 0"), f"patterns{n}")
        if n == rounds - 1:
            break
        # What an instance's patterns leave unlikely, multiplied.
        unsure = edges.join(patterns, "pattern").groupBy("instance").agg(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))).alias("log"))
        likely = settled(unsure.select("instance", F.round(1 - F.exp("log"), 9).alias("likely")), f"instances{n}")
        scored = edges.join(likely, "instance", "left").select(
            "pattern", "instance", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("likely", F.lit(0.0))).alias("score")
        )
    return patterns.where((F.col("confidence") >= confidence) & (F.col("known") >= least_seeds)).select("pattern")


def _joined(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, counts per base kind, ``base_sha256``, ``spans``
    and ``n_context``, the number of spans the contexts add."""
    rows = settled(_spans_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "spans")

    base = F.concat(*[F.transform(k, lambda s: s) for k in KINDS])
    seeds = rows.select(F.explode(base).alias("s")).select(
        _instance(F.col("s.value")).alias("instance"), F.lit(True).alias("seed"), _patterns(F.col("s.before"), F.col("s.after")).alias("p")
    )
    value = F.col("s.value")
    lead = F.char_length(F.regexp_extract(value, LEAD, 0))
    trail = F.char_length(F.regexp_extract(value, TRAIL, 0))
    core = _instance(F.regexp_replace(F.regexp_replace(value, LEAD, ""), TRAIL, ""))
    tokens = rows.select("id", "mark", F.explode("token").alias("s")).select(
        "id", "mark", (F.col("s.start") + lead).alias("start"), (F.col("s.end") - trail).alias("end"),
        core.alias("instance"), _patterns(F.col("s.before"), F.col("s.after")).alias("p"),
    )
    digits = F.char_length(F.regexp_replace("instance", r"[^0-9]+", ""))
    shaped = F.char_length("instance").between(*IDENTIFIER) & ((digits >= 4) | F.col("instance").contains("@"))
    tokens = tokens.where(shaped)

    seen = seeds.unionByName(tokens.select("instance", F.lit(False).alias("seed"), "p"))
    pairs = seen.select("instance", "seed", F.explode("p").alias("pattern"))
    edges = settled(pairs.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    # A value that is a seed anywhere is one everywhere.
    known = edges.groupBy("instance").agg(F.max("seed").alias("seed"))
    edges = settled(edges.drop("seed").join(known, "instance"), "graph")
    patterns = settled(confident(edges, **how), "confident")

    added = tokens.withColumn("pattern", F.explode("p")).join(patterns, "pattern", "left_semi")
    added = added.groupBy("id", "mark").agg(F.collect_set(F.struct("start", "end")).alias("added"))
    added = settled(added, "added").select(F.col("id").alias("added_id"), F.col("mark").alias("added_mark"), "added")
    whole = rows.join(added, F.col("id").eqNullSafe(F.col("added_id")) & (F.col("mark") == F.col("added_mark")), "left")
    every = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    fresh = F.filter("added", lambda a: ~F.exists("every", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    whole = whole.withColumn("every", F.when(F.col("added").isNotNull(), every))
    whole = whole.withColumn("context", F.coalesce(F.array_sort(fresh), F.array().cast("array<struct<start:bigint,end:bigint>>")))
    listed = F.concat(*[_joined(F.col(k), k) for k in KINDS])
    return whole.select(
        F.col("id").alias(id_col),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(listed, _joined(F.col("context"), "context")), ",").alias("spans"),
        F.size("context").cast("long").alias("n_context"),
    )
