"""The pipeline against its stages done by hand on a small table."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline as C

from . import cases
from .test_mixing import brute as mix_brute
from .test_near_dedup import brute as near_brute
from .test_near_dedup import edited
from .test_packing import check
from .test_quality import brute as counts


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    import random

    r = random.Random(3)
    texts = [cases.prose(r.randint(60, 400), i) for i in range(40)]
    texts += texts[:6] + [edited(t, 2, r) for t in texts[:10]] + ["short", "", None, " ".join(["again and again"] * 40)] + [cases.prose(9000, 99)]
    rows = {"doc_id": list(range(len(texts))), "text": texts, "lang": ["en"] * len(texts), "source": [f"s{i % 3}" for i in range(len(texts))], "n_chars": [len(t or "") for t in texts]}
    path = tmp_path_factory.mktemp("sf")
    pq.write_table(pa.table(rows), path / "documents.parquet")
    return str(path), list(zip(rows["doc_id"], rows["source"], texts))


def test_against_the_stages_by_hand(spark, folder):
    path, docs = folder
    good = []
    for i, source, text in docs:
        n, *_, repeated = counts(text)
        if n >= 50 and 100 * repeated <= 50 * n:
            good.append((i, source, text))
    last = {t: i for i, _, t in good}
    exact = [d for d in good if last[d[2]] == d[0]]
    label = near_brute([(i, t) for i, _, t in exact])
    near = [d for d in exact if label[d[0]] == d[0]]
    mix = {i: taken // size for i, size, _, taken in mix_brute([(i, s, len(t.split())) for i, s, t in near])}
    want = [(i, t) for i, _, t in near for _ in range(mix[i])]
    rows = C.run(spark, path).collect()
    assert Counter((r.doc_id, r.piece) for r in rows).keys() >= {(i, 0) for i, _ in want}
    check(rows, want, 4096)


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns


def test_stages_over_odd_rows_and_none(spark):
    for docs in (cases.odd(spark), cases.table(spark, [])):
        for _, stage in C.STAGES:
            docs = stage(spark, docs, "")
        docs.collect()
