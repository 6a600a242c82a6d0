"""Centroid clustering (k-means) by Walsh-Hadamard progressive search.

A vector's components become integers, and the Walsh-Hadamard transform (sums
and differences, so integers too) of vectors and centroids keeps distances: the
squared differences of the coefficients add up to ``DIMENSIONS`` times those of
the components. The coefficients with few changes of sign hold the coarse shape
and come first. Squared differences are added from coarse to fine; after each
step the centroid that looks nearest is measured whole, and a centroid whose sum
is already above that is strictly worse and goes. What is left is measured over
all coefficients, so the answer is exact and ties are seen.

Each round is one pass: a batch leaves its task as one sum of coefficients per
centroid, and only ``k`` sums come to the driver, where the transform turns them
back into sums of components. Centroids travel with the code: k x 64 numbers.

Defined results: a vector of another length, or with a component that is null,
not finite or an integer beyond ``LARGEST`` (64 squared differences of such
would not fit in a long) is left out; a vector without an id is assigned but
never starts a centroid; vectors that share an id start in the order of their
coefficients; a table of fewer vectors than ``k`` has as many centroids as vectors
with an id, and without any no vector has a cluster; inertia that does not fit
in a long is null; an empty table gives no rows; further columns are left alone.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.llm.common import settled

DIMENSIONS, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, "2"
LARGEST = 1 << 24
# Coefficients known after each step, and vectors searched at once.
STEPS, AT_ONCE = (4, 16, DIMENSIONS), 4096


def coarse_first(size: int) -> np.ndarray:
    """Rows of the Hadamard matrix by their changes of sign."""
    signs = np.array([[(row & at).bit_count() & 1 for at in range(size)] for row in range(size)])
    return np.argsort((signs[:, 1:] != signs[:, :-1]).sum(axis=1), kind="stable")


ORDER = coarse_first(DIMENSIONS)


def _butterflies(x: np.ndarray) -> np.ndarray:
    out = np.array(x)
    for step in (1 << i for i in range(DIMENSIONS.bit_length() - 1)):
        pairs = out.reshape(len(out), DIMENSIONS // (2 * step), 2, step)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
    return out


def transform(x: np.ndarray) -> np.ndarray:
    """Coefficients of each row, coarse ones first."""
    return _butterflies(x)[:, ORDER]


def restored(coefficients: np.ndarray) -> np.ndarray:
    """The components of each row of coefficients: exact, as they came from integers."""
    back = np.empty_like(coefficients)
    back[:, ORDER] = coefficients
    return _butterflies(back) // DIMENSIONS


def _least(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Where each row's least value stands; of equals the first. Rows ascend."""
    first = np.searchsorted(rows, np.arange(n))
    found = np.flatnonzero(values == np.minimum.reduceat(values, first)[rows])
    return found[np.searchsorted(rows[found], np.arange(n))]


def _squares(gap: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", gap, gap)


def nearest(vectors: np.ndarray, centroids: np.ndarray, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """For each row of coefficients the nearest centroid (of equals the first)
    and the squared distance of the components."""
    n = len(vectors)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows, which = np.repeat(np.arange(n), len(centroids)), np.tile(np.arange(len(centroids)), n)
    sums, done = np.zeros(len(rows), np.int64), 0
    for upto in steps:
        sums = sums + _squares(vectors[rows, done:upto] - centroids[which, done:upto])
        done = upto
        if upto < DIMENSIONS:
            looks = which[_least(sums, rows, n)]
            live = sums <= _squares(vectors - centroids[looks])[rows]
            rows, which, sums = rows[live], which[live], sums[live]
    best = _least(sums, rows, n)
    return which[best], sums[best] // DIMENSIONS


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and coefficients, some vectors at a time."""
    for batch in batches:
        for at in range(0, len(batch), AT_ONCE):
            some = batch.slice(at, AT_ONCE)
            yield some.column(0), some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


def coefficients(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, c): the integer vectors that are kept, transformed."""
    x, least, most = F.col("x"), F.lit(-float(LARGEST)), F.lit(float(LARGEST))
    scaled = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda c: c * F.lit(float(SCALE)))
    # Comparisons with a null, and with what is no number, are never below a bound.
    kept = vectors.select(F.col(f"`{id_col}`").alias("id"), scaled.alias("x")).where(
        (F.size(x) == DIMENSIONS) & F.forall(x, lambda c: c.isNotNull() & (c >= least) & (c < most + 1))
    )

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat in _batches(batches):
            made = pa.array(list(transform(flat)), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, made], names=["id", "c"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.select("id", F.transform(x, lambda c: F.floor(c)).alias("v")).mapInArrow(turn, f"id {kind}, c array<long>")


def starts(rows: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """Components of the ``k`` vectors whose ids have the smallest hashes."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    some = rows.where("id IS NOT NULL").select(mark.alias("mark"), "c").orderBy("mark", "c").limit(k).collect()
    return restored(np.array([r["c"] for r in some], np.int64).reshape(-1, DIMENSIONS))


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, list[int]]:
    """The sums of all coefficients, and the number of vectors, of each cluster that has some."""
    known = transform(centroids)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat in _batches(batches):
            cluster, _ = nearest(flat, known)
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            sums = np.add.reduceat(flat[order], first, axis=0) if len(found) else flat[:0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()), pa.array(np.diff(np.r_[first, len(flat)]), pa.int64()), pa.array(list(sums), pa.list_(pa.int64()))],
                names=["cluster", "n", "sums"],
            )

    per_batch = rows.mapInArrow(gather, "cluster long, n long, sums array<long>")
    # The count goes as one more coefficient.
    each = per_batch.select("cluster", F.posexplode(F.concat("sums", F.array("n"))).alias("at", "x"))
    out: dict[int, list[int]] = {}
    for r in each.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s")).collect():
        out.setdefault(r["cluster"], [0] * (DIMENSIONS + 1))[r["at"]] = int(r["s"])
    return out


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid that has vectors replaced by the floor of their mean."""
    out = centroids.copy()
    for cluster, (*total, n) in _sums(rows, centroids).items():
        out[cluster] = [s // n for s in restored(np.array([total], object))[0]]
    return out


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    known = transform(centroids)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, flat in _batches(batches):
            cluster, distance = nearest(flat, known)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["id", "cluster", "distance"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(find, f"id {kind}, cluster int, distance long")


def clustered(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, seed: str = SEED
) -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia
    and the sha256 of its final centroid."""
    spark = vectors.sparkSession
    rows = settled(coefficients(vectors, id_col, vector_col), "coefficients")
    centroids = starts(rows, k, seed)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), *none)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    found = settled(assigned(rows, centroids), "assigned")
    # One row per centroid from here on.
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    fits = lambda n: n if n < 1 << 63 else None
    total = fits(sum(int(r["s"]) for r in sums))
    marks = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    named = [(r["cluster"], fits(int(r["s"])), total, marks[r["cluster"]]) for r in sums]
    per_cluster = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most k rows, whatever the input.
    return found.join(F.broadcast(per_cluster), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
