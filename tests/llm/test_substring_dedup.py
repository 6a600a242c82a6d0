import re
from collections import Counter

import pytest

from rankframe.llm import queries as Q
from rankframe.llm import substring_dedup as S

from . import cases


def sentences(n, seed, length=9):
    words = cases.prose(n * length, seed).split()
    return [" ".join(words[i * length : (i + 1) * length]).capitalize() + "." for i in range(n)]


def run(spark, records, **how):
    return {r.doc_id: r for r in S.without_repeats(spark.createDataFrame(records, "doc_id long, text string").repartition(3), **how).collect()}


def brute(records, least_words=S.LEAST_WORDS):
    """Repeated lines of least_words words, each a unit of its own, by hand."""
    seen, out = set(), {}
    for i, text in sorted(records):
        kept = []
        for line in text.split("\n"):
            plain = re.sub(r"\W+", " ", line).strip().lower()
            if plain in seen and len(plain.split()) >= least_words:
                continue
            seen.add(plain)
            kept.append(line)
        out[i] = kept
    return out


def test_repeated_lines_as_brute_force(spark):
    pool = [cases.prose(12, 500 + i) + "." for i in range(40)]
    import random

    r = random.Random(7)
    records = [(i, "\n".join(r.sample(pool, 3) + [cases.prose(15, i) + "."])) for i in range(80)]
    want, rows = brute(records), run(spark, records)
    for i, text in records:
        assert [x for x in rows[i].text.split("\n") if x.strip()] == want[i]
        assert "".join(text[k.start : k.end] for k in rows[i].kept) == rows[i].text
        assert len(rows[i].removed) + len(rows[i].kept) >= 1 and all(x.first_id < i or x.first_id == i for x in rows[i].removed)


def test_a_passage_within_other_text(spark):
    passage = " ".join(sentences(7, 1)[:4]) + "\n" + " ".join(sentences(7, 1)[4:])
    records = [(i, cases.prose(40, 10 + i) + " " + passage + " " + cases.prose(40, 50 + i)) for i in range(5)] + [(9, " ".join(sentences(10, 77)))]
    rows = run(spark, records)
    assert rows[0].n_removed == 0 and rows[0].text == records[0][1]
    assert rows[9].n_removed == 0 and rows[9].text == records[5][1]
    for i in range(1, 5):
        assert rows[i].n_removed >= 50 and {x.first_id for x in rows[i].removed} == {0}
        span = rows[i].removed[0]
        assert records[i][1][span.start : span.end] in passage


def test_form_does_not_matter_and_short_things_stay(spark):
    line = "The Quick brown fox jumps over a very lazy dog, again and again"
    rows = run(spark, [(0, line + "."), (1, "x\n" + line.upper() + "!\ny"), (2, "Yes.\nNo."), (3, "Yes.\nNo."), (4, "Under the terms of this.\nz"), (5, "q\nunder the terms of this")])
    assert rows[1].text == "x\n\ny" and rows[3].n_removed == 0 and rows[4].n_removed == 0 and rows[5].text == "q\n"


def test_repeated_lines_of_any_length_go(spark):
    two, three = "The and attion to thanedble the, anea. Eriner thanea.", "All rights reserved."
    first, second = "Enmentai. Of, edti oner.", "Yes. No. Well."
    records = [(i, "\n".join([cases.prose(12, 900 + i), two, cases.prose(12, 700 + i), three, first, cases.prose(9, 300 + i), second])) for i in range(4)]
    rows = run(spark, records)
    assert rows[0].text == records[0][1]
    for i in range(1, 4):
        parts = records[i][1].split("\n")
        assert [x for x in rows[i].text.split("\n") if x.strip()] == [parts[0], parts[2], parts[5]]
        assert {x.first_id for x in rows[i].removed} == {0} and rows[i].n_removed == 9 + 3 + 4 + 3
    # Within a line short sentences stay, beside a line that goes or not.
    rows = run(spark, [(0, "a b c d e f. All rights reserved.\nUnder the terms.\nx y z"), (1, "g h i j k l. All rights reserved.\nUnder the terms.\nm n o")])
    assert rows[1].text == "g h i j k l. All rights reserved.\n\nm n o"


@pytest.mark.parametrize("mark", ["", ","])
def test_a_passage_without_marks(spark, mark):
    words = cases.prose(60, 5).split()
    passage = " ".join(words[:30]) + mark + " " + " ".join(words[30:])
    records = [(i, f"{cases.prose(25 + i, 10 + i)} {passage} {cases.prose(31 - i, 50 + i)}") for i in range(20)]
    rows = run(spark, records)
    assert rows[0].n_removed == 0
    for i in range(1, 20):
        assert rows[i].n_removed >= 30 and all(x.first_id < i for x in rows[i].removed)
        assert all(records[i][1][x.start : x.end] in passage for x in rows[i].removed)


def test_other_scripts(spark):
    import random

    def letters(n, seed, first, last):
        r = random.Random(seed)
        return "".join(chr(r.randrange(first, last)) for _ in range(n))

    chinese = [letters(14, i, 0x4E00, 0x9FA0) + "。" for i in range(5)]
    thai = letters(120, 9, 0xE01, 0xE2F)
    hindi = " ".join(letters(4, i, 0x905, 0x930) for i in range(12)) + "।"
    arabic = " ".join(letters(4, i, 0x620, 0x63B) for i in range(12)) + "؟"
    han = lambda i: letters(20, 100 + i, 0x4E00, 0x9FA0)
    for passage, least in (("".join(chinese), 60), (thai, 80), (hindi, len(hindi)), (arabic, len(arabic))):
        space = " " if " " in passage else ""
        side = han if passage is not thai else lambda i: letters(20, 100 + i, 0xE01, 0xE2F)
        if space:
            side = lambda i: cases.prose(6, 100 + i) + "."
        rows = run(spark, [(i, side(i) + space + passage + space + side(50 + i)) for i in range(3)])
        assert rows[0].n_removed == 0
        for i in (1, 2):
            assert sum(x.end - x.start for x in rows[i].removed) >= least - 8 * (space == ""), passage
    rows = run(spark, [(0, han(1) + "\n" + chinese[0]), (1, chinese[0] + "\n" + han(2))])
    assert rows[1].text == "\n" + han(2) and rows[1].n_removed == 7
    # Vowel signs tell words apart.
    assert S.units("कक की का कि कू")[2][0] != S.units("कक का की कू कि")[2][0]


def test_a_hot_line(spark):
    line = cases.prose(15, 3)
    rows = run(spark, [(i, f"{cases.prose(8, 100 + i)}\n{line}") for i in range(400)])
    assert sum(r.n_removed == 15 for r in rows.values()) == 399 and rows[0].n_removed == 0


def test_odd_rows(spark):
    docs = cases.odd(spark)
    rows = S.without_repeats(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].text is None and by[1].text == "" and by[7].n_removed == 0 and by[8].n_removed == 60_000
    assert sum(r.n_removed for r in rows if r.doc_id is None) == 0
    assert S.without_repeats(cases.table(spark, [])).collect() == []


@pytest.mark.parametrize("text", ["a b c d. e f g h i", "one, two three four: five " * 9, "x\n\ny z w v\n", "  lead. \n tail "])
def test_units_cover_all_words(text):
    starts, ends, _, _ = S.units(text)
    assert starts[0] == 0 and (starts[1:] == ends[:-1]).all() and ends[-1] == len(text.split())


def test_the_query(spark):
    rows = Q.QUERIES["op9_substring_dedup"](spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert Counter(r.doc_id for r in rows) == Counter(texts.keys())
    for r in rows:
        assert "".join(texts[r.doc_id][k.start : k.end] for k in r.kept) == r.text


def test_places_of_words_as_the_pattern_finds_them():
    texts = ["", " ", "a", " a\tb\n\x0bc ", "\x1c a\x85b\u00a0c \u3000 d", "é😀 ü\tß\x1fx", "一二 三，四 abc", "w " * 500 + "end"]
    for text in texts:
        begins, ceases = S._places(text)
        assert list(zip(begins.tolist(), ceases.tolist())) == [m.span() for m in S._words_by(text).finditer(text)]


def test_digests_are_made_of_what_is_looked_up_alone(monkeypatch):
    """A line of one sentence is digested once, and no text again to be cut."""
    words, real = [], S._digested

    def digested(marks, starts, ends):
        words.append(int((ends - starts).sum()))
        return real(marks, starts, ends)

    monkeypatch.setattr(S, "_digested", digested)
    text = "\n".join(f"one two three four five six {i}." for i in range(20))
    found = S._looked_up(text)
    assert words == [140] and len(found[0]) == 20
    assert S._runs(text, {(0, 7): 5}, 5, 5) == [(0, 30, 5, 7)] and words == [140]
