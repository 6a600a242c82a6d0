"""Filters, scores, phrases and logs."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rankframe.operators import judge as J
from rankframe.operators import logs as L
from rankframe.operators import phrases as P


def test_filters(spark):
    rows = spark.createDataFrame(
        [(1, "a", False, 0.7), (1, "b", False, 0.4), (1, "c", True, 0.9), (1, "d", False, None), (2, "e", False, None), (2, "f", True, None)],
        "job_id long, t string, offtopic boolean, similarity double",
    )

    def kept(mode=None, least=None):
        return "".join(sorted(r.t for r in J.filter_suggestions(rows, mode, least).collect()))

    assert (kept("none"), kept("words"), kept("meaning"), kept("meaning", 0.3), kept()) == ("abcdef", "abde", "ade", "abde", "ade")
    got = {r.job_id: (r.total, r.cut) for r in J.filter_counts(rows, "meaning").collect()}
    assert got == {1: (4, 2), 2: (2, 1)}
    assert {r.job_id: (r.has_scores, r.unscored) for r in J.score_state(rows).collect()} == {1: (True, 1), 2: (False, 2)}


def test_threshold_and_mode():
    assert [J.threshold(x) for x in (None, "x", "nan", "0.1", "0.95", 0.6, "inf")] == [0.54, 0.54, 0.54, 0.3, 0.8, 0.6, 0.8]
    assert [J.filter_mode(m, s) for m, s in ((None, True), (None, False), ("meaning", False), ("odd", True), ("none", True))] == [
        "meaning", "words", "words", "meaning", "none",
    ]
    assert J.filter_mode("", True, keep_offtopic=True) == "none"


def test_backfill_scores_only_the_unscored(spark):
    results = spark.createDataFrame(
        [(1, 0, "x", None), (1, 0, "y", 0.25), (1, 0, "z", None), (1, 0, "nought", None)], "job_id long, ordinal long, title string, similarity double"
    )
    queries = spark.createDataFrame([(1, 0, "k")], "job_id long, ordinal long, text string")
    vectors = spark.createDataFrame([("k", [1.0, 0.0]), ("x", [3.0, 4.0]), ("nought", [0.0, 0.0])], "phrase string, vector array<double>")
    once = J.score_backfill(results, queries, vectors)
    want = {"x": 0.6, "y": 0.25, "z": None, "nought": 0.0}
    assert {r.title: r.similarity for r in once.collect()} == pytest.approx(want)
    assert {r.title: r.similarity for r in J.score_backfill(once, queries, vectors).collect()} == pytest.approx(want)


def test_pairs_of_a_common_completion_are_not_shuffled_by_it(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRS_OF_ONE", 2)
    rows = [("k", "x"), ("l", "x"), ("k", "x"), ("l", "y"), ("k", "none"), ("k", "none"), ("k", "none"), (None, "x"), ("k", None)]
    pairs = spark.createDataFrame(rows, "key string, text string")
    vectors = spark.createDataFrame(
        [("k", [1.0, 0.0]), ("l", [0.0, 1.0]), ("x", [3.0, 4.0]), ("y", [4.0, 3.0])], "phrase string, vector array<double>"
    )
    want = [("k", "x", 0.6), ("l", "x", 0.8), ("k", "x", 0.6), ("l", "y", 0.6), *[("k", "none", None)] * 3, (None, "x", None), ("k", None, None)]
    scored = J.score_pairs(pairs, vectors, counted=pairs)
    got = [(r.key, r.text, None if r.similarity is None else round(r.similarity, 9)) for r in scored.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    told = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in told and "strategy=broadcast" in told


PIECES = {"▁": -3.0, "a": -4.0, "b": -4.0, "▁a": -3.5, "ab": -5.0, "ba": -4.5, "▁ab": -6.0, "aba": -8.5, "!": -5.0}


def every_cut(text):
    """The best cut by trying all of them; unknown letters one by one."""
    best = None
    for gaps in itertools.product((0, 1), repeat=len(text) - 1):
        parts, start = [], 0
        for i, cut in enumerate(gaps, 1):
            if cut:
                parts.append(text[start:i])
                start = i
        parts.append(text[start:])
        if any(p not in PIECES and len(p) > 1 for p in parts):
            continue
        score = sum(PIECES.get(p, min(PIECES.values()) - 10) for p in parts)
        best = score if best is None else max(best, score)
    return best


def test_tokens_against_every_cut(spark):
    rng = random.Random(3)
    phrases = sorted({"".join(rng.choice("abx ") for _ in range(rng.randint(1, 9))).strip() for _ in range(60)} | {"a!b", ""})
    ids = {p: i + 1 for i, p in enumerate(PIECES)}
    vocab = spark.createDataFrame([(p, ids[p], s) for p, s in PIECES.items()] + [("<unk>", 0, 0.0)], "piece string, id long, score double")
    frame = spark.createDataFrame([(p,) for p in phrases], "phrase string")
    normal = {r.phrase: r.n for r in frame.select("phrase", P.normalise_phrase("phrase").alias("n")).collect()}
    back = {i: p for p, i in ids.items()}
    rows = P.tokenise_phrases(frame, vocab, unknown_id=0).collect()
    assert len(rows) == len(phrases)
    for r in rows:
        text = normal[r.phrase]
        if not text:
            assert r.tokens == []
            continue
        assert all((a, b) != (0, 0) for a, b in itertools.pairwise(r.tokens))
        # Read the pieces back along the text; an unknown piece is a run of x.
        at, score = 0, 0.0
        for t in r.tokens:
            if t == 0:
                run = len(text[at:]) - len(text[at:].lstrip("x"))
                at, score = at + run, score + run * (min(PIECES.values()) - 10)
            else:
                assert text.startswith(back[t], at)
                at, score = at + len(back[t]), score + PIECES[back[t]]
        assert at == len(text) and math.isclose(score, every_cut(text))


def test_a_long_phrase_is_cut_whole(spark):
    vocab = spark.createDataFrame([(p, i + 1, s) for i, (p, s) in enumerate(PIECES.items())], "piece string, id long, score double")
    frame = spark.createDataFrame([("ab " * 33_334,)], "phrase string")
    tokens = P.tokenise_phrases(frame, vocab, unknown_id=0).first().tokens
    assert tokens == [list(PIECES).index("▁ab") + 1] * 33_334


def test_normalised_phrases(spark):
    rows = spark.createDataFrame([("Coffee,  maker/x ",), ("  ",), ("a\t\nb",)], "c string")
    got = [r.x for r in rows.select(P.normalise_phrase("c").alias("x")).collect()]
    assert got == ["▁Coffee▁,▁maker▁/▁x", "", "▁a▁b"]
    # Half-width and full-width forms, ligatures, accents apart, an odd blank, a sign that stands for a word.
    odd = ["ｶﾞｲﾄﾞ", "ＡＢＣ　１，２", "ﬁne eﬀort", "cafe\u0301", "a\u00a0b", "№ 5", None]
    rows = spark.createDataFrame([(t,) for t in odd], "c string")
    got = [r.x for r in rows.select(P.normalise_phrase("c").alias("x")).collect()]
    assert got[:6] == ["▁ガイド", "▁ABC▁1▁,▁2", "▁fine▁effort", "▁café", "▁a▁b", "▁No▁5"]


def test_embedding(spark):
    vocab = spark.createDataFrame([(1, 0.5, [2, 0]), (2, 0.1, [0, 40])], "id long, scale double, q array<int>")
    tokens = spark.createDataFrame([("p", [1, 1, 2]), ("none", [])], "phrase string, tokens array<long>")
    got = {r.phrase: r.vector for r in P.embed_phrases(tokens, vocab).collect()}
    length = math.sqrt(2**2 + 4**2)
    assert got["p"] == pytest.approx([2 / length, 4 / length]) and got["none"] == [0.0, 0.0]


def random_events(seed, n=500):
    rng = random.Random(seed)
    return [(rng.randint(1, 6), i * rng.choice([1, 40]), i, rng.random() < 0.8, rng.random() < 0.25) for i in range(n)]


def rhythm_by_loop(events):
    out = {}
    for session in {e[0] for e in events}:
        checked, since, sums = False, 0, [0, 0, 0, 0]
        for _, _, _, admitted, marked in sorted((e for e in events if e[0] == session), key=lambda e: (e[1], e[2])):
            sums[0] += 1
            sums[1] += marked
            if not admitted:
                checked, since = marked, 0
            elif marked:
                if checked:
                    sums[2] += 1
                    sums[3] += since
                checked, since = True, 0
            else:
                since += 1
        out[session] = tuple(sums)
    return out


def event_frame(spark, events):
    frame = spark.createDataFrame(events, "session long, sec long, event_id long, admitted boolean, marked boolean")
    return frame.withColumn("ts", F.timestamp_seconds("sec"))


def test_rhythm_against_a_loop(spark):
    events = random_events(1)
    got = L.marked_stretches(event_frame(spark, events)).collect()
    assert {r.session: (r.answered, r.met, r.intervals, r.carried) for r in got} == rhythm_by_loop(events)


def test_census(spark):
    rows = [(1, 0, 0, "a"), (1, 60, 1, "b"), (2, 30, 2, "a"), (2, 500, 3, "b"), (3, 90, 4, "b"), (3, 90, 5, "a")]
    frame = spark.createDataFrame(rows, "entity long, sec long, event_id long, state string").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r.state: r for r in L.state_census(frame, F.timestamp_seconds(F.lit(100))).collect()}
    assert (got["a"].entities, got["a"].spent_seconds, got["a"].longest_seconds) == (2, 60 + 70 + 10, 70)
    assert (got["b"].entities, got["b"].spent_seconds, got["b"].longest_seconds) == (1, 40, 40)
    assert got["a"].share == pytest.approx(140 / 180)


def test_the_length_of_a_vector_is_worked_out_once_per_phrase(spark):
    vectors = spark.createDataFrame([("a", [3.0, 4.0]), ("b", [4.0, 3.0]), ("0", [0.0, 0.0]), ("n", None)], "phrase string, vector array<double>")
    pairs = spark.createDataFrame([("a", "b"), ("a", "a"), ("a", "0"), ("a", "n"), ("a", "x"), (None, "b")], "key string, text string")
    scored = J.score_pairs(pairs, vectors)
    got = {(r["key"], r["text"]): r.similarity for r in scored.collect()}
    assert got == {("a", "b"): 0.96, ("a", "a"): 1.0, ("a", "0"): 0.0, ("a", "n"): None, ("a", "x"): None, (None, "b"): None}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    # One root beside each side's vectors, none where the pairs are compared.
    assert plan.split("\n")[0].upper().count("SQRT") == 0 and plan.upper().count("SQRT") == 2, plan
