import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from rankframe.llm import clustering as C

SCHEMA = "vec_id long, embedding array<float>, label int, cluster int, id string, `c` string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 7, "x", "y") for i, v in vectors], SCHEMA)


def brute(vectors, k=40, rounds=5):
    """Plain loops over Python integers."""
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in vectors
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    turned = lambda v: C.transform(np.array([v], np.int64))[0].tolist()
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), turned(v), v) for i, v in kept if i is not None)
    centroids = [v for *_, v in named[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, held in groups.items():
            centroids[n] = [sum(x) // len(held) for x in zip(*held)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {n: sum(d for _, m, d in found if m == n) for _, n, _ in found}
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), mark[n]) for i, n, d in found), key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def made(n, seed, spread=1.0):
    r = random.Random(seed)
    return [(i, [float(np.float32(r.gauss(0, spread))) for _ in range(64)]) for i in range(n)]


def test_the_transform_keeps_distances():
    r = np.random.default_rng(1)
    x, y = r.integers(-(1 << 24), 1 << 24, (2, 50, 64))
    plain = ((x - y) ** 2).sum(axis=1)
    assert (C._squares(C.transform(x) - C.transform(y)) == 64 * plain).all()
    assert (C.restored(C.transform(x)) == x).all()
    # The coarse end: all of one sign first, then one change.
    signs = C._butterflies(np.eye(64, dtype=np.int64))[:, C.ORDER].T
    assert [(np.diff(s) != 0).sum() for s in signs] == list(range(64))


def test_search_equals_measuring_all():
    r = np.random.default_rng(2)
    x, c = r.integers(-9, 9, (300, 64)), r.integers(-9, 9, (40, 64))
    c[7], c[30], x[5] = c[3], c[3], c[3]
    all_of = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for steps in (C.STEPS, (1, 2, 64), (64,)):
        which, distance = C.nearest(C.transform(x), C.transform(c), steps)
        assert (which == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()
    assert which[5] == 3  # of equals the smaller number


def test_as_brute_force(spark):
    vectors = made(300, 3, 0.2)
    assert got(C.clustered(table(spark, vectors).repartition(5))) == brute(vectors)


def test_odd_rows(spark):
    vectors = made(50, 4)
    vectors += [(60, None), (61, []), (62, [1.0] * 63), (63, [1.0] * 65), (64, [None] + [1.0] * 63), (65, [float("nan")] * 64), (66, [float("inf")] + [0.0] * 63)]
    vectors += [(None, vectors[0][1]), (None, [0.5] * 64), (3, vectors[9][1]), vectors[1], vectors[1], (70, [-65536.0] * 64), (71, [65536.0] * 64)]
    assert got(C.clustered(table(spark, vectors).repartition(3))) == brute(vectors)
    # Too large for exact distances in a long, as the docstring says.
    more = vectors + [(80, [1e30] + [0.0] * 63)]
    assert got(C.clustered(table(spark, more))) == brute(vectors)


def test_an_empty_centroid_stays(spark):
    # Equal starts: all but the first are never nearest.
    vectors = [(i, [1.0] * 64) for i in range(60)] + [(100 + i, [2.0] * 64) for i in range(3)]
    rows = got(C.clustered(table(spark, vectors)))
    assert rows == brute(vectors)


def test_few_and_none(spark):
    few = made(5, 5)
    assert got(C.clustered(table(spark, few))) == brute(few)
    assert C.clustered(table(spark, [])).collect() == []
    nameless = [(None, v) for _, v in few]
    assert {(r.vec_id, r.cluster, r.distance) for r in C.clustered(table(spark, nameless)).collect()} == {(None, None, None)}


def test_a_round_sends_one_row_per_centroid(spark):
    rows = C.coefficients(table(spark, made(200, 6)).repartition(4), "vec_id", "embedding")
    centroids = C.starts(rows, 8)
    sums = C._sums(rows, centroids)
    assert set(sums) <= set(range(8)) and sum(s[-1] for s in sums.values()) == 200


def test_whole_table(spark, tmp_path):
    """The registered query against the brute force on the driver's smallest table."""
    from rankframe.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.col("embedding")).collect()]
    assert got(QUERIES["op11_clustering"](spark, folder)) == brute(rows)
