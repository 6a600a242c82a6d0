import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from rankframe.llm import quality as Q

from . import cases


def brute(text):
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_counts_as_brute_force():
    r = random.Random(6)
    texts = [None, "", " \n\t", "a", "a a a a", "x\ny\nx\n \n \nx", "é😀 |\x1fb"]
    texts += ["".join(r.choice(["a ", "b ", "c\n", "#", " ", "d", "\x85", "\xa0"]) for _ in range(r.randint(1, 120))) for _ in range(600)]
    for text in texts:
        assert Q.counted(text) == brute(text)


def test_chi_square():
    assert abs(Q.chi2_below(4.351, 5) - 0.5) < 1e-3 and abs(Q.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def normal(n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, Q.P)) * (1, 0.3, 0.5, 0.4, 0.2) + (5, 1, 1, 0, 0.5)
    x[:, 1] += 0.2 * x[:, 0]
    return x


def squared(inverse):
    out = np.zeros((Q.P, Q.P))
    for (i, j), v in zip(Q.PAIRS, inverse):
        out[i, j] = out[j, i] = v
    return out


def by_hand(x, start):
    """Trial and concentration steps of one start until its determinant falls no more."""
    correction = Q.SHARE / Q.chi2_below(Q.chi2_quantile(Q.SHARE, Q.P), Q.P + 2)
    best, steps = (np.array(start.centre), squared(start.inverse), np.inf), 0
    while True:
        gap = x - best[0]
        cell = np.floor(50 * np.log(np.einsum("ni,ij,nj->n", gap, best[1], gap) + 1e-6))
        near = x[cell <= np.sort(cell)[int(np.ceil(Q.SHARE * len(x))) - 1]]
        inverse, det = Q.bounded(correction * np.cov(near.T, bias=True))
        if steps >= Q.TRIAL and not det < best[2] - Q.LEAST_FALL:
            return best
        best, steps = (near.mean(0), inverse, det), steps + 1


def framed(spark, x):
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], ["group", *[f"x{i}" for i in range(Q.P)]]).repartition(6)
    return rows, rows.groupBy("group").agg(F.count(F.lit(1)).alias("size"))


def test_estimate_withstands_outliers(spark):
    x = normal(3000, 1)
    x[:500] += (3, 2, 4, 0, 0)
    rows, sizes = framed(spark, x)
    row = Q.estimates(rows).first()
    clean = x[500:]
    assert np.abs(np.array(row.centre) - clean.mean(0)).max() < 0.1
    assert np.abs(np.linalg.inv(squared(row.inverse)) - np.cov(clean.T)).max() < 0.3
    # All starts, done by hand: the least determinant is the one that is taken.
    begun = {r.start: r for r in Q.starts(rows, sizes).collect()}
    assert set(begun) >= {0, 1} and len(begun) >= 4
    ends = {n: by_hand(x, r) for n, r in begun.items()}
    centre, inverse, det = ends[row.start]
    assert np.allclose(centre, row.centre, atol=1e-6) and np.allclose(inverse, squared(row.inverse), rtol=1e-4) and abs(det - row.det) < 1e-6
    assert row.det <= min(d for _, _, d in ends.values()) + 0.05


def test_a_bad_start_does_not_win(spark, monkeypatch):
    x = normal(2000, 2)
    x[:450] = x[:450] * 0.05 + (9, 6, 7, 5, 4)
    rows, sizes = framed(spark, x)
    whole = Q.starts(rows, sizes).collect()
    good = next(r for r in whole if r.start == 0)
    tight = np.linalg.inv(np.diag([0.5, 0.1, 0.1, 0.1, 0.1]) ** 2)
    bad = good.asDict() | {"centre": x[:450].mean(0).tolist(), "inverse": [float(tight[i, j]) for i, j in Q.PAIRS]}

    def only(*made):
        frame = spark.createDataFrame([tuple((m if isinstance(m, dict) else m.asDict())[c] for c in ("group", "start", "centre", "inverse", "det")) for m in made], Q.ESTIMATE)
        monkeypatch.setattr(Q, "starts", lambda rows, sizes: frame)
        return Q.estimates(rows).first()

    alone, better = only(bad), only(good)
    both = only(bad | {"start": 7}, good)
    assert better.det < alone.det and both.det == better.det and both.start == 0


def test_spread_is_bounded_below():
    cov = np.diag([4.0, 1e-9, 0.0, 0.25, 0.01])
    inverse, det = Q.bounded(cov)
    least = np.square(Q.FLOORS)
    assert np.allclose(np.linalg.inv(inverse), np.diag(np.maximum(np.diag(cov), least)))
    assert abs(det - np.log(np.maximum(np.diag(cov), least)).sum()) < 1e-9
    # Two statistics that only vary together: the mixture that does not vary is bounded too.
    cov[0, 0], cov[1, 1] = 1.0, 0.04
    cov[0, 1] = cov[1, 0] = 0.2
    assert np.linalg.eigvalsh(np.linalg.inv(Q.bounded(cov)[0]) / np.outer(Q.FLOORS, Q.FLOORS)).min() > 0.999


def test_junk_goes_and_clean_stays(spark):
    texts = [cases.prose(60 + 5 * i, i, 9000) for i in range(60)]
    junk = ["".join(f"w{i}{n}### " for n in range(100)) for i in range(3)]
    docs = cases.table(spark, cases.rows(texts + junk + ["too short"]))
    rows = {r.doc_id: r for r in Q.judged(docs).collect()}
    assert [i for i in range(60) if not rows[i].kept] == []
    assert all(not rows[i].kept and not rows[i].base_failed for i in (60, 61, 62)) and rows[63].base_failed and not rows[63].kept
    assert {r.doc_id for r in Q.without_outliers(docs).collect()} == {i for i, r in rows.items() if r.kept}


def test_small_groups_are_judged_by_wider_ones(spark):
    clean = [(cases.prose(60 + 5 * (i % 40), i, 9000), "en", f"s{i // 4}") for i in range(120)]
    clean += [(cases.prose(90, 700 + i, 9000), "de", "own") for i in range(3)]
    junk = [("".join(f"w{i}{n}### " for n in range(100)), lang, source) for i, (lang, source) in enumerate([("en", "s3"), ("en", "tiny"), ("fr", "t"), (None, None)])]
    records = [r for i, (t, lang, source) in enumerate(clean + junk) for r in cases.rows([t], lang, source, i)]
    docs = cases.table(spark, records)
    rows = Q.judged(docs).collect()
    assert all(r.distance is not None for r in rows) and {r.doc_id for r in rows if not r.kept} == {123, 124, 125, 126}
    assert Q.without_outliers(docs).count() == 123


def test_odd_rows(spark):
    docs = cases.odd(spark)
    rows = Q.judged(docs).collect()
    assert sorted((r.doc_id, *(r[c] for c in Q.COUNTS)) for r in rows if r.doc_id is not None) == sorted(
        (r.doc_id, *brute(r.text)) for r in docs.collect() if r.doc_id is not None
    )
    # Every row that passes the base rule has a distance; here none is far.
    assert all(r.kept == (not r.base_failed) and (r.base_failed or r.distance is not None) for r in rows)
    stays = Q.without_outliers(docs)
    assert stays.columns == docs.columns and stays.count() == sum(r.kept for r in rows)
    same = docs.withColumn("stats", F.lit(1)).withColumn("group", F.lit("x")).withColumn("centre", F.lit("x"))
    assert Q.without_outliers(same).columns == same.columns and Q.judged(same).count() == len(rows)
    empty = cases.table(spark, [])
    assert Q.judged(empty).collect() == [] and Q.without_outliers(empty).collect() == []
