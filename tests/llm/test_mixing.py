from collections import Counter
from hashlib import md5

import pytest

from rankframe.llm import mixing as M

from . import cases


def brute(records, share=1.5, weights=(3, 1, 2), limit=2.0):
    sizes = Counter()
    for _, source, size in records:
        sizes[source] += size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in order if s not in capped)
        level = (share * total - limit * sum(sizes[s] for s in capped)) / free if free else 0
        above = {s for s in order if s not in capped and w[s] * level > limit * sizes[s]}
        if not above:
            break
        capped |= above
    targets = {s: limit * sizes[s] if s in capped else w[s] * level for s in order}
    out = []
    for i, source, size in records:
        rate = targets[source] / sizes[source] if sizes[source] else 0
        draw = int(md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        out.append((i, size, targets[source], size * (int(rate) + (draw < rate - int(rate)))))
    return sorted(out, key=str)


def got(frame):
    return sorted([(r.doc_id, r.size, r.target, r.size * r.copies) for r in frame.collect()], key=str)


def test_as_brute_force(spark):
    texts = [(i, s, 1 + i * 7 % 90) for i in range(300) for s in [["a", "B", "é", None, "z", "aa", "b"][min(i % 11, 6)]]]
    docs = spark.createDataFrame([(i, " \n".join(["w"] * n), s) for i, s, n in texts], "doc_id long, text string, source string")
    for how in ({}, {"share": 1.9}, {"share": 0.3}, {"weights": (5, 1)}):
        assert got(M.weighed(docs, **how)) == brute(texts, **how)
    mix = Counter(r.doc_id for r in M.mixed(docs).collect())
    assert {i: n for i, n in mix.items()} == {r.doc_id: r.copies for r in M.weighed(docs).collect() if r.copies}


def test_targets_are_met_and_bounded(spark):
    docs = spark.createDataFrame([(i, "a b c d", f"s{min(i % 9, 4)}") for i in range(12000)], "doc_id long, text string, source string")
    rows = M.weighed(docs).collect()
    taken, target = Counter(), {}
    for r in rows:
        source = min(r.doc_id % 9, 4)
        taken[source] += r.size * r.copies
        target[source] = r.target
        assert r.copies <= 2
    assert all(abs(taken[s] - target[s]) < 0.06 * target[s] for s in target)
    assert got(M.weighed(docs)) == got(M.weighed(docs.repartition(5)))


def test_odd_rows(spark):
    docs = cases.odd(spark)
    records = [(r.doc_id, r.source, len([w for w in __import__("re").split("[ \t-\r]+", r.text or "") if w])) for r in docs.collect()]
    assert got(M.weighed(docs)) == brute(records)
    assert M.mixed(docs).columns == docs.columns
    blank = cases.table(spark, cases.rows([None, "", " "]))
    assert {(r.size, r.target, r.copies) for r in M.weighed(blank).collect()} == {(0, 0.0, 0)}
    assert M.mixed(cases.table(spark, [])).collect() == [] and M.weighed(cases.table(spark, [])).collect() == []
    with pytest.raises(ValueError):
        M.weighed(docs, share=3.0)
