"""Words, relatedness, echoes, alphabets."""

import random

import pytest
from pyspark.sql import functions as F

from rankframe.functions import text as X
from rankframe.functions import vectors as V
from rankframe.operators import suggest as S

RELATED = [
    ("кофемашина", "кофемашины для дома", True), ("expresso", "espresso machine", True), ("kofemashina", "кофемашина", True),
    ("coffee maker", "coffeemaker", True), ("coffeemaker", "coffee maker", True), ("coffee_maker", "best coffee maker", True),
    ("pl ai", "jpl airport", False), ("ai", "air", False), ("как для", "что угодно", True), ("для кофе", "для чая", False),
    ("bestcoffeegrinder", "grinder for espresso", True), ("smart", "art", False), ("фото", "фотографий", True),
    ("фото редактор", "photo shop", False), ("нейросеть", "neyroseti", True), ("3d", "3d printer", True),
]


@pytest.mark.parametrize("key, completion, yes", RELATED)
def test_related(spark, key, completion, yes):
    rows = spark.createDataFrame([(key, completion)], "k string, c string")
    assert rows.select(X.related_to_key("k", "c").alias("x")).first().x is yes


def test_words(spark):
    rows = spark.createDataFrame([("Кофе_машина, 3D! объявление ь",), ("",), ("Été",)], "c string")
    got = [r.w for r in rows.select(X.words("c").alias("w")).collect()]
    assert got == [["kofe", "mashina", "3d", "obyavlenie", ""], [], ["été"]]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_same(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 4:
        return False
    common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    shorter = min(len(a), len(b))
    return (common >= 4 and common * 3 >= shorter * 2) or edits(a, b) <= (2 if shorter >= 7 else 1)


def test_same_word_against_a_loop(spark):
    rng = random.Random(1)

    def word():
        return "".join(rng.choice("abкш") for _ in range(rng.randint(1, 10)))

    pairs = []
    for _ in range(400):
        a = word()
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b.insert(rng.randint(0, len(b)), rng.choice("abк"))
        pairs.append((a, "".join(b)[: rng.randint(1, 12)]))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", X.same_word("a", "b").alias("x")).collect()
    assert [(r.a, r.b) for r in rows if r.x != plain_same(r.a, r.b)] == []


def test_variants(spark):
    keys = spark.createDataFrame([(" two  words ", "de-AT"), ("x", "zz"), ("  ", "en")], "key string, lang string")
    rows = S.suggest_variants(keys, multiword=True).orderBy("key", "variant").collect()
    x = [r for r in rows if r.key == "x"]
    assert len(x) == 3 + 4 * 36 and [r.text for r in x[:4]] == ["x", "x ", " x", "x a"]
    assert x[3].letter == "a" and x[3].echo == ["x", "a"] and x[3].cursor == 1
    two = [r for r in rows if r.key == "two  words"]
    # Single blanks split the key: two gaps, one of them around an empty word.
    assert len(two) == 3 + 4 * 30 + 2 * 30
    gap = two[3 + 4 * 30]
    assert (gap.text, gap.cursor, gap.letter, gap.echo) == ("two a  words", 5, "a", ["two", "a"])
    assert two[-1].text == "two  ß words" and two[-1].cursor == 6
    assert S.suggest_variants(keys, multiword=True, limit=5).count() == 10


def test_cursor_counts_bytes(spark):
    keys = spark.createDataFrame([("кофе дом", "ru")], "key string, lang string")
    last = S.suggest_variants(keys, multiword=True).orderBy(F.desc("variant")).first()
    assert (last.text, last.cursor) == ("кофе б дом", 10)


def test_alphabets():
    sizes = {k: len(v) for k, v in S.ALPHABETS.items()}
    assert sizes["ru"] == 32 and sizes["de"] == 30 and sizes["ar"] == 28 and sizes["th"] == 42 + 10
    assert len(S.ALPHABETS) == 29 and all(len(set(v)) == len(v) for v in S.ALPHABETS.values())
    assert "".join(S.ALPHABETS["vi"][:14]) == "abcdđefghijklm"
    assert "áàảãạăắằẳẵặâ" in "".join(S.ALPHABETS["vi"]) and "ýỳỷỹỵ0" in "".join(S.ALPHABETS["vi"])
    assert "".join(S.ALPHABETS["ja"][:46]) == "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん"
    assert "".join(S.ALPHABETS["hi"][:12]) == "अआइईउऊएऐओऔकख" and len(S.ALPHABETS["ja"]) == 46 * 2 + 36


@pytest.mark.parametrize("completion, letter, echo, lang, yes", [
    ("кофе р дома", "р", ["кофе", "р"], "ru", True), ("кофе в дома", "в", ["кофе", "в"], "ru", False),
    ("coffee 5 cups", "5", ["coffee", "5"], "en", False), ("coffee x", "x", ["coffee", "x", "y"], "en", False),
    ("Coffee  X now", "x", ["coffee", "x"], "pt-br", True), ("coffee e", "e", ["coffee", "e"], "pt-br", True),
    ("coffee e", "e", ["coffee", "e"], "PT", False), ("coffee", "", [], "en", False),
])
def test_echoes(spark, completion, letter, echo, lang, yes):
    rows = spark.createDataFrame([(completion, letter, echo, lang)], "text string, letter string, echo array<string>, lang string")
    assert S.drop_echoes(rows).isEmpty() is yes


def test_answers(spark):
    guard = ")]}'\n"
    rows = [
        (1, 200, "﻿" + guard + '[[["coffee <b>maker</b>",0],["a &amp; b"],["",0],[5],"x",[null],[" &nbsp; "]],{}]'),
        (2, 200, "<html>"), (3, 429, "[[]]"), (4, 403, ""), (5, 500, ""), (6, 200, "[[]]"), (7, 200, '{"a":1}'), (8, 200, '["x"]'),
    ]
    answers = spark.createDataFrame(rows, "id int, status int, body string")
    read, texts = S.parse_suggest_answers(answers)
    assert {r.id: r["class"] for r in read.collect()} == {1: "", 2: "wall", 3: "wall", 4: "banned", 5: "http", 6: "", 7: "wall", 8: "wall"}
    assert [(r.id, r.text) for r in texts.orderBy("position").collect()] == [(1, "coffee maker"), (1, "a & b")]


def test_settle_keys(spark):
    probes = spark.createDataFrame([("a", True), ("a", False), ("b", False), ("c", True), ("c", None)], "key string, answered boolean")
    found = spark.createDataFrame(
        [("a", 2, 0, "x"), ("a", 1, 1, "y"), ("a", 1, 0, "x"), ("c", 0, 0, "z")], "key string, variant long, position int, text string"
    )
    keys, rows = S.settle_keys(probes, found)
    assert {r.key: r.state for r in keys.collect()} == {"a": "done", "b": "failed", "c": "pending"}
    assert [(r.key, r.position, r.text) for r in rows.orderBy("position").collect()] == [("a", 1, "x"), ("a", 2, "y")]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, -2.0], [2.0, -4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = rows.select(V.closeness("a", "b").alias("c"), V.quantised("a").alias("q")).collect()
    assert [round(r.c, 9) for r in got] == [1.0, 0.0]
    assert got[0].q.q == [64, -127] and got[1].q.q == [0, 0] and got[1].q.scale == 0
    bad = spark.createDataFrame([([1.0, float("nan")],), ([float("inf")],)], "a array<double>")
    assert [r.q for r in bad.select(V.quantised("a").alias("q")).collect()] == [None, None]
