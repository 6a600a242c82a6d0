"""Small tables with what real ones hold: nulls, blanks, ties, repeats, long texts."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, `__text` int, id string, `key` array<int>"


def rows(texts, lang="en", source="s0", first=0):
    return [(first + i, t, lang, source, len(t or ""), "x", 1, "y", [1]) for i, t in enumerate(texts)]


def table(spark, records):
    return spark.createDataFrame(records, SCHEMA)


def prose(n, seed, words=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def odd(spark):
    """Nulls in any column, blanks, whole repeats, and a very long text."""
    long = prose(60_000, 1)
    records = rows([None, "", "  \n ", "one", "one two three", prose(80, 2), prose(80, 2), long, long, "é😀 ü\tß\x1fx"])
    records += [records[5], records[5], (None, prose(70, 3), None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return table(spark, records)
