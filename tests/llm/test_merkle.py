import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from rankframe.llm import merkle as M

from . import cases


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def bent(row):
    text = row[4]
    if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
        text = text.replace("\n", "")
    return (*row[:4], text)


def tree(nodes):
    """The root, and for each node the levels of (left, right) siblings."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for k, p in enumerate(at):
            run = runs[p // 3]
            proofs[k].append(("".join(run[: p % 3]), "".join(run[p % 3 + 1 :])))
        at, nodes = [p // 3 for p in at], [H(*r) for r in runs]
    return nodes[0], proofs


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    held = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[source], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        held.append((own, *tree([leaf(r) for r in own])))
    if not held:
        return []
    root, tops = tree([subroot for _, subroot, _ in held])
    out = []
    for (own, subroot, proofs), top in zip(held, tops):
        for r, proof in zip(own, proofs):
            acc = leaf(bent(r))
            for left, right in proof + top:
                acc = H(left, acc, right)
            out.append((r[0], leaf(r), subroot, root, H(*[x for e in proof + top for x in e]), acc, acc == root))
    return sorted(out, key=str)


def tampered():
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return {"text": F.when(hit, F.translate("text", "\n", "")).otherwise(F.col("text"))}


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def plain(docs):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]


@pytest.mark.parametrize("sources, n", [(1, 1), (1, 2), (1, 28), (2, 2), (5, 200), (40, 60), (3, 700)])
def test_as_brute_force(spark, sources, n):
    r = random.Random(sources * 1000 + n)
    rows = [(i, f"s{int(r.random() ** 3 * sources)}", "en", 3, r.choice(["a\nb", "ab", f"t{i}", ""])) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert got(M.audited(docs, tampered)) == brute(rows)


def test_odd_rows(spark):
    records = [*cases.odd(spark).collect()]
    more = [(7, "x\ny", None, "é", 2, None, None, None, None), (7, "x\ny", None, "", 2, None, None, None, None), (-3, "\n", "z", "~", None, None, None, None, None)]
    docs = cases.table(spark, [tuple(r) for r in records] + more).repartition(3)
    rows = plain(docs)
    assert got(M.audited(docs, tampered)) == brute(rows)
    # Any order of input gives one root; without tampering everything verifies.
    again = M.audited(docs.repartition(7, "n_chars"))
    assert {r.verified for r in again.collect()} == {True}
    assert {r.root for r in again.collect()} == {brute(rows)[0][3]}


def test_nothing(spark):
    assert M.audited(cases.table(spark, []), tampered).collect() == []


def test_equal_rows_are_spread(spark, monkeypatch):
    rows = [(None, None, None, None, "same")] * 400 + [(1, "s", None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    assert got(M.audited(docs, tampered)) == brute(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    written, own = {}, M.settled
    monkeypatch.setattr(M, "settled", lambda frame, name: written.setdefault(name, own(frame, name)))
    try:
        ranges = M.placed(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("grp")), "grp", ["id"], "t")
        places = sorted(r.place for r in ranges.where("grp IS NULL").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert places == list(range(400))
    assert written["t"].select(F.shiftright("at", 33).alias("r")).distinct().count() > 1


def test_a_changed_sibling_fails(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    out = M.audited(docs, lambda: {"n_chars": F.when(F.col("doc_id") == 4, 2).otherwise(F.col("n_chars"))}).collect()
    assert {r.doc_id for r in out if not r.verified} == {4}
