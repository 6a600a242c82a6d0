"""Suggestion probes: the questions asked about a key, and their answers."""

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.functions.text import fields
from rankframe.functions.urls import strip
from rankframe.operators.running import numbered

_LATIN = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"


# The letters each language's keys are tried with, in order.
ALPHABETS: dict[str, list[str]] = {
    "ru": list("йцукенгшщзфывапролдячсмитьхъжэюб"),
    "de": list(_LATIN + "äöüß"),
    "es": [*_LATIN, "ñ", "rr", "ll", "ch"],
    "fr": [*_LATIN, "é", "à", "è", "ùâ", *"êîôûëïüÿç"],
    "pt": list(_LATIN + "áâãàçéêíóôõú"),
    "ar": (
        "ألف باء تاء ثاء جيم حاء خاء دال ذال راء زاي سين شين صٓاد ضاد طاء ظاء عين غين فاء قاف كاف لام ميم نون واو هاء ياء"
    ).split(),
    "it": list(_LATIN + "àèéìòù" + _DIGITS),
    "nl": list(_LATIN + "éëïóöü" + _DIGITS),
    "sv": list(_LATIN + "åäö" + _DIGITS),
    "da": list(_LATIN + "æøå" + _DIGITS),
    "no": list(_LATIN + "æøå" + _DIGITS),
    "fi": list(_LATIN + "äöå" + _DIGITS),
    "pl": list(_LATIN + "ąćęłńóśźż" + _DIGITS),
    "cs": list(_LATIN + "áčďéěíňóřšťúůýž" + _DIGITS),
    "sk": list(_LATIN + "áäčďéíĺľňóôŕšťúýž" + _DIGITS),
    "hu": list(_LATIN + "áéíóöőúüű" + _DIGITS),
    "ro": list(_LATIN + "ăâîșţț" + _DIGITS),
    "hr": list(_LATIN + "čćđšž" + _DIGITS),
    "sl": list(_LATIN + "čšž" + _DIGITS),
    "tr": list("abcçdefgğhıijklmnoöprsştuüvyzqwx" + _DIGITS),
    "uk": list("абвгґдеєжзиіїйклмнопрстуфхцчшщьюя" + _DIGITS),
    "bg": list("абвгдежзийклмнопрстуфхцчшщъьюя" + _DIGITS),
    "el": list("αβγδεζηθικλμνξοπρσςτυφχψω" + _DIGITS),
    "he": list("אבגדהוזחטיכךלמםנןסעפףצץקרשת" + _DIGITS),
    "hi": list("अआइईउऊएऐओऔकखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह" + _DIGITS),
    "th": list("กขคฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮ" + _DIGITS),
    "vi": list("abcdđefghijklmnopqrstuvwxyzáàảãạăắằẳẵặâấầẩẫậéèẻẽẹêếềểễệíìỉĩịóòỏõọôốồổỗộơớờởỡợúùủũụưứừửữựýỳỷỹỵ" + _DIGITS),
    "ja": list("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをんアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン" + _LATIN + _DIGITS),
    "ko": list("ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎㅏㅑㅓㅕㅗㅛㅜㅠㅡㅣ" + _LATIN + _DIGITS),
}
DEFAULT_ALPHABET = list(_LATIN + _DIGITS)
# The words of one letter each language writes.
ONE_LETTER_WORDS = {
    "en": "a i", "ru": "в с и к у о а", "uk": "в у і й з о а", "bg": "в и с к у о а", "de": "",
    "es": "a e o u y", "fr": "a à y", "pt": "a e o à é", "it": "a e i o è", "nl": "u",
    "pl": "a i o u w z", "cs": "a i k o s u v z", "sk": "a i k o s u v z", "sl": "a i k o s v z",
    "hr": "a i k o s u", "ro": "a e o", "sv": "i å ö", "no": "i å", "da": "i å",
}
PLAIN_VARIANTS = 3  # the key, the key and a blank, a blank and the key
LETTER_PATTERNS = 4  # key blank letter, key letter, letter blank key, letter key
GUARD = ")]}'"


def _by_language(table: dict[str, list[str]], language: Column, default: list[str]) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]).cast("array<string>"))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), language), F.array(*[F.lit(w) for w in default]))


def alphabet(language: Column) -> Column:
    """The letters of a language, its region left out."""
    base = F.regexp_replace(F.lower(strip(language)), r"^([^\-_]+)[\-_].*$", "$1")
    return _by_language(ALPHABETS, F.when(base == "pg", "pt").otherwise(base), DEFAULT_ALPHABET)


def suggest_variants(keys: DataFrame, multiword: bool = False, limit: int = 0) -> DataFrame:
    """Every question asked about each key, in order, repeats kept.

    ``keys`` has ``key`` and ``lang``; adds variant, text, cursor, letter, echo.
    A variant is worked out from its number, so nothing is gathered per key and
    a limit only shortens the count.
    """
    ready = keys.withColumn("key", strip("key")).where(F.col("key") != "")
    ready = ready.withColumns({"__letters": alphabet(F.col("lang")), "__words": F.split("key", " ")})
    n = F.size("__letters")
    gaps = (F.size("__words") - 1) if multiword else F.lit(0)
    total = F.lit(PLAIN_VARIANTS) + n * (LETTER_PATTERNS + gaps)
    if limit > 0:
        total = F.least(total, F.lit(limit))
    rows = ready.select("*", F.explode(F.sequence(F.lit(0), total - 1)).alias("variant"))
    at = F.col("variant") - PLAIN_VARIANTS
    rows = rows.withColumns({
        "__pattern": F.when(at >= 0, F.floor(at / n).cast("int")).otherwise(-1),
        "__letter": F.when(at >= 0, F.get("__letters", at % n)).otherwise(""),
    })
    pattern, a, key, words = F.col("__pattern"), F.col("__letter"), F.col("key"), F.col("__words")
    gap = pattern - LETTER_PATTERNS + 1
    blank = F.lit(" ")
    before = F.concat(F.array_join(F.slice(words, 1, F.greatest(gap, F.lit(0))), " "), blank, a)
    after = F.array_join(F.slice(words, F.greatest(gap, F.lit(0)) + 1, F.size(words)), " ")
    text = (
        F.when(F.col("variant") == 0, key)
        .when(F.col("variant") == 1, F.concat(key, blank))
        .when(F.col("variant") == 2, F.concat(blank, key))
        .when(pattern == 0, F.concat(key, blank, a))
        .when(pattern == 1, F.concat(key, a))
        .when(pattern == 2, F.concat(a, blank, key))
        .when(pattern == 3, F.concat(a, key))
        .otherwise(F.concat(before, blank, after))
    )
    typed = F.when(pattern == 0, F.concat(key, blank, a)).when(pattern == 2, a).when(pattern >= LETTER_PATTERNS, before)
    # The i-th blank of the text, counted in bytes, and two on from it.
    rows = rows.withColumns({"text": text, "__typed": typed, "__gap": gap})
    cursor = F.when(pattern >= LETTER_PATTERNS, F.expr("octet_length(substring_index(text, ' ', __gap)) + 2")).otherwise(1)
    return rows.select(
        *keys.columns,
        "variant",
        "text",
        cursor.alias("cursor"),
        F.when(F.col("__typed").isNotNull(), a).otherwise("").alias("letter"),
        F.when(F.col("__typed").isNotNull(), fields(F.lower("__typed")))
        .otherwise(F.array().cast("array<string>"))
        .alias("echo"),
    )


def stands_alone(letter: Column, language: Column) -> Column:
    """Whether a letter is a word of the language by itself, or a digit."""
    table = {k: v.split() for k, v in ONE_LETTER_WORDS.items()}
    alone = _by_language(table, F.lower(language), ONE_LETTER_WORDS["en"].split())
    return letter.rlike(r"^\p{Nd}$") | F.array_contains(alone, F.lower(letter))


def is_echo(completion: Column, letter: Column, echo: Column, language: Column) -> Column:
    """Whether a completion is the question handed back: its letter still
    stands alone where it was typed."""
    begins = F.slice(fields(F.lower(completion)), 1, F.greatest(F.size(echo), F.lit(1)))
    return (letter != "") & (F.size(echo) > 0) & ~stands_alone(letter, language) & (begins == echo)


def drop_echoes(completions: DataFrame, text: str = "text") -> DataFrame:
    """Completions (with letter, echo and lang of their question) that answer it."""
    return completions.where(~is_echo(F.col(text), F.col("letter"), F.col("echo"), F.col("lang")))


@F.pandas_udf(T.StringType())
def _entities(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def parse_suggest_answers(answers: DataFrame, plain: bool = False) -> tuple[DataFrame, DataFrame]:
    """Captured answers (status, body, and any keys) read into completions.

    Gives the answers with ``class`` ('' where a list was read) and the
    completions, one row each with ``position`` in its answer. ``plain`` reads
    the [typed, [texts…]] form.
    """
    body = strip(F.regexp_replace("body", r"^\x{FEFF}", ""))
    body = strip(F.when(body.startswith(GUARD), F.substring(body, F.lit(len(GUARD) + 1), F.length(body))).otherwise(body))
    # JSON to its end, and a list of lists; in the plain form a list of texts.
    # What follows the end goes unseen unless the whole stands in brackets.
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    listed = F.try_variant_get(whole, f"$[0][{1 if plain else 0}]", "variant")
    kind = F.schema_of_variant(listed)
    good = kind.isin("ARRAY<STRING>", "ARRAY<VOID>") if plain else kind.startswith("ARRAY<")
    good = good & F.try_variant_get(whole, "$[1]", "variant").isNull()
    items = F.when(good, F.from_json(F.to_json(listed), "array<string>"))
    read = answers.withColumn("__items", items)
    status = F.col("status")
    refusal = (
        F.when(status == 429, "wall").when(status == 403, "banned").when(status != 200, "http")
        .when(F.col("__items").isNull(), "wall").otherwise("")
    )
    read = read.withColumn("class", refusal)
    items = read.where(F.col("class") == "").select(*answers.columns, F.posexplode("__items").alias("__at", "__item"))
    raw = F.col("__item")
    if not plain:
        # Only an item that is a list and opens with a text counts.
        texted = raw.rlike(r'^\s*\[\s*"')
        raw = F.when(texted, F.get(F.from_json(raw, "array<string>"), F.lit(0)))
        raw = F.regexp_replace(raw, "<[^>]+>", "")
    texts = items.withColumn("text", strip(_entities(raw)) if not plain else raw).where(F.col("text") != "")
    completions = texts.select(
        *[c for c in answers.columns if c not in ("body", "status")], F.col("__at").alias("position"), "text"
    )
    return read.drop("__items"), completions


def settle_keys(probes: DataFrame, completions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each key comes to once its questions are in.

    ``probes`` (key, variant, answered): true, false for a refusal, null for a
    question not asked yet. A key with such a question stays pending, one
    without any answer fails. ``completions`` (key, variant, position, text)
    of done keys are kept once, numbered in the order they first came back:
    by variant, then position.
    """
    counted = probes.groupBy("key").agg(
        F.count_if(F.col("answered").isNull()).alias("open"), F.count_if(F.col("answered")).alias("answers")
    )
    state = F.when(F.col("open") > 0, "pending").when(F.col("answers") == 0, "failed").otherwise("done")
    keys = counted.select("key", state.alias("state"))
    once = completions.groupBy("key", "text").agg(F.min(F.struct("variant", "position")).alias("__at"))
    flat = once.select("key", "text", F.col("__at.variant").alias("__v"), F.col("__at.position").alias("__p"))
    placed = numbered(flat, ["key"], [F.col("__v")], ["__v", "__p"], "position")
    done = keys.where(F.col("state") == "done").select("key")
    return keys, placed.select("key", "position", "text").join(done, "key", "left_semi")
