import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe.llm import packing as P
from rankframe.llm.queries import word_tokenizer

from . import cases

tokenizers = pytest.importorskip("tokenizers")
PATH = word_tokenizer()


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, records, capacity):
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    want = []
    for i, text in records:
        ids = ids_of(tokenizer, text)
        for n, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            want.append((i, n, at, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    for mine in bins.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


@pytest.mark.parametrize("per_task", [10_000, 40])
def test_as_brute_force(spark, per_task):
    r = random.Random(3)
    records = [(i, cases.prose(r.choice([1, 5, 40, 90, 200, 700]), i)) for i in range(300)]
    docs = spark.createDataFrame(records, "doc_id long, text string")
    rows = P.packed_documents(docs, PATH, capacity=512, per_task=per_task, fan=2).collect()
    used, least = check(rows, records, 512)
    # No worse than best fit of everything at once, but for a few bins.
    alone = len(P.best_fit(sorted((r.length for r in rows), reverse=True), 512))
    assert least <= used <= (1.02 if per_task == 40 else 1) * alone


def test_texts_word_by_word():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    r = random.Random(2)
    signs = list("abZÉéßİΣσ'sreµªº²½19.,!…“ \t\n\x1c\x1f\x85\xa0　́̇<|>$é😀ſK") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'re"]
    texts = [None, "", "x" * 300] + ["".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for text, packed in zip(texts, P.token_bytes(texts, PATH)):
        assert packed == np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_best_fit():
    bins = P.best_fit([6, 5, 4, 3, 2], 10)
    assert bins == [[0, 2], [1, 3, 4]]
    r = random.Random(1)
    lengths = sorted((r.randint(1, 100) for _ in range(500)), reverse=True)
    bins = P.best_fit(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(500))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins) and len(bins) <= 1.05 * sum(lengths) / 100 + 1


def test_items_that_fill_no_bin_stay_with_their_tasks(spark):
    items = spark.range(400).select(F.lit(300).cast("long").alias("length"), "id")
    rows = P.packed(items, capacity=512, per_task=20, fan=2).collect()
    assert len(rows) == 400 == len({r.sequence_id for r in rows})


def test_odd_rows(spark):
    docs = cases.odd(spark)
    records = [(r.doc_id, r.text) for r in docs.collect()]
    check(P.packed_documents(docs, PATH).collect(), records, 4096)
    assert P.packed_documents(cases.table(spark, []), PATH).collect() == []


def test_new_words_are_found_without_a_walk_of_the_table():
    class Still(P._Words):
        def __iter__(self):
            raise AssertionError("the table was walked")

    known = Still(PATH)
    for words in ({"alpha", "beta,"}, {"beta,", "gamma", "наука"}):
        known.learn(words)
    for word in ("alpha", "beta,", "gamma", "наука"):
        ids = known.tokenizer.encode(word, add_special_tokens=False).ids
        assert known[word] == b"".join(i.to_bytes(4, "little") for i in ids)
    assert {"alpha", "beta", "gamma"} <= set(known.keys())
