"""Quality rules by robust multivariate outliers: for each language and source
the minimum covariance determinant of transformed text statistics, and a
Mahalanobis distance for every document.

The estimate is looked for from several starts: medians and median deviations,
means and covariances, and small random sets of rows. From each, concentration
steps go over all rows: distances are counted in narrow logarithmic bins together
with the moments of their rows, and the bins that hold the nearest ``share`` of a
group give the next mean and covariance. After ``TRIAL`` steps the start with the
least determinant goes on, until its determinant falls no more. A group is reduced
to its bins before the shuffle, so its size does not matter, and all groups are
estimated in the same passes. ``FLOORS`` is the least spread of each statistic, and
of any mixture of them in these units: what hardly varies in a group must not
make trifles outliers.

Defined results: a null or empty text has no words and fails the base rule; null
languages and sources are groups like any other; groups of fewer than
``least_rows`` documents that pass the base rule are judged by the estimate of
their language over all sources, and languages of fewer by that of the whole
corpus, however small, so that every document that passes the base rule has a
distance; rows that repeat are judged alike; an empty table gives no rows;
further columns are left alone.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from rankframe.llm.common import settled
from rankframe.llm.wording import tidied, words_of

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, LEAST_ROWS, SHARE, TAIL = 50, 30, 0.75, 1e-9
# Random sets of rows to start from and their rows on average, steps of every
# start, steps of the best one at most, and the fall of a log determinant that counts.
SETS, SET_ROWS, TRIAL, STEPS, LEAST_FALL, SEED = 3, 20, 2, 15, 1e-6, 11
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Words, word length, symbols per word, repeated lines, repeated windows.
FLOORS = (0.5, 0.1, 0.05, 0.1, 0.1)
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_BLANK = " \t\n\r\x0b\x0c"


def _repeat_words(words: list[str]) -> int:
    """Words that lie in a window of three words found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[str, int] = {}
    numbers = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pairs = numbers[:-1] * len(known) + numbers[1:]
    if len(known) > 2_000_000:  # three numbers no longer fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(known) + numbers[2:]
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(windows, again)
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[i : i + len(hit)] |= hit
    return int(covered.sum())


def counted(text: str | None) -> tuple[int, int, int, int, int]:
    words = words_of(text)
    if not words:
        return 0, 0, sum(map((text or "").count, SYMBOLS)), 0, 0
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeat_words(words),
    )


@F.pandas_udf(StructType([StructField(c, LongType()) for c in COUNTS]))
def statistics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([counted(t) for t in text], columns=list(COUNTS), dtype="int64")


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def _vector(stats: Column) -> list[Column]:
    words = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    return [
        F.log(words),
        F.log((stats["word_chars"] + 1) / words),
        F.log1p(stats["n_symbols"] / words),
        F.log1p(stats["n_dup_lines"]) / F.lit(4.0),
        F.sqrt(stats["n_repeat_words"] / words),
    ]


def chi2_below(x: float, k: int) -> float:
    """The chance that a chi-square variable of k degrees is below x."""
    if x <= 0:
        return 0.0
    term = math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2 + 1))
    total, n = term, k / 2
    while term > 1e-17 * total:
        n += 1
        term *= x / 2 / n
        total += term
    return min(1.0, total)


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, k) < p else (low, middle)
    return high


def _distance(x: list[Column], centre: Column, inverse: Column) -> Column:
    gap = [x[i] - centre[i] for i in range(P)]
    parts = [inverse[n] * gap[i] * gap[j] * (1.0 if i == j else 2.0) for n, (i, j) in enumerate(PAIRS)]
    return sum(parts[1:], parts[0])


def _start(rows: DataFrame) -> DataFrame:
    """Median and median deviation of each statistic, from one count of narrow bins."""
    width = 0.02
    cells = rows.select("group", F.posexplode(F.array(*[F.floor(F.col(f"x{i}") / width) for i in range(P)])).alias("axis", "cell"))
    counts = cells.groupBy("group", "axis", "cell").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("group", "axis")

    def middle(frame: DataFrame, value: str) -> DataFrame:
        upto = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        half = 2 * F.sum("n").over(upto) >= F.sum("n").over(whole)
        return frame.withColumn("_half", half).withColumn("_mid", F.min(F.when(F.col("_half"), F.col(value))).over(whole)).drop("_half")

    centred = middle(counts, "cell").withColumnRenamed("_mid", "median").withColumn("gap", F.abs(F.col("cell") - F.col("median")))
    spread = middle(centred, "gap").groupBy("group", "axis").agg(F.first("median").alias("median"), F.first("_mid").alias("mad"))
    floors = F.array(*[F.lit(f) for f in FLOORS])
    sigma = F.greatest(1.4826 * width * F.col("mad"), F.get(floors, F.col("axis")))
    per_axis = spread.select("group", F.struct("axis", ((F.col("median") + 0.5) * width).alias("c"), (1 / (sigma * sigma)).alias("v")).alias("a"))
    ordered = per_axis.groupBy("group").agg(F.array_sort(F.collect_list("a")).alias("axes"))  # P entries
    inverse = F.array(*[F.col("axes")[i]["v"] if i == j else F.lit(0.0) for i, j in PAIRS])
    return ordered.select("group", F.transform("axes", lambda a: a["c"]).alias("centre"), inverse.alias("inverse"))


def bounded(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse and log determinant of a covariance whose spread is nowhere below ``FLOORS``."""
    units = np.array(FLOORS)
    values, vectors = np.linalg.eigh(cov / np.outer(units, units))
    values = np.maximum(values, 1.0)
    inverse = (vectors / values) @ vectors.T / np.outer(units, units)
    return inverse, float(np.log(values).sum() + 2 * np.log(units).sum())


def _inverted(correction: float):
    """Moments of rows to centre, inverse covariance and log determinant, one row per group and start."""

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, inverses, dets = [], [], []
            for row in batch.to_pylist():
                mean = np.array(row["sums"]) / row["n"]
                cov = np.zeros((P, P))
                for (i, j), s in zip(PAIRS, row["products"]):
                    cov[i, j] = cov[j, i] = s / row["n"] - mean[i] * mean[j]
                inverse, det = bounded(correction * cov)
                centres.append(mean.tolist())
                inverses.append([inverse[i, j] for i, j in PAIRS])
                dets.append(det)
            floats = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(centres, floats), pa.array(inverses, floats), pa.array(dets, pa.float64())],
                names=["group", "start", "centre", "inverse", "det"],
            )

    return invert


ESTIMATE = "group string, start int, centre array<double>, inverse array<double>, det double"


def _x() -> list[Column]:
    return [F.col(f"x{i}") for i in range(P)]


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    x = _x()
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)],
        *[F.sum(x[i] * x[j]).alias(f"p{n}") for n, (i, j) in enumerate(PAIRS)],
    )


def _estimated(moments: DataFrame, correction: float) -> DataFrame:
    sums, products = F.array(*[f"s{i}" for i in range(P)]), F.array(*[f"p{n}" for n in range(len(PAIRS))])
    return moments.select("group", "start", "n", sums.alias("sums"), products.alias("products")).mapInArrow(_inverted(correction), ESTIMATE)


def starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Where the search begins: one row per group and start."""
    medians = _start(rows).select("group", F.lit(0).alias("start"), "centre", "inverse", F.lit(float("inf")).alias("det"))
    whole = float(1 << 62)
    draws = [F.pmod(F.xxhash64(F.lit(SEED + n), *_x()), F.lit(1 << 62)) < F.lit(whole * SET_ROWS) / F.col("size") for n in range(SETS)]
    which = F.array_compact(F.array(F.lit(1), *[F.when(d, F.lit(2 + n)) for n, d in enumerate(draws)]))
    drawn = rows.join(sizes, "group").withColumn("start", F.explode(which))
    # A set of fewer rows than it has directions says nothing.
    sets = _moments(drawn, "group", "start").where((F.col("start") == 1) | (F.col("n") > P))
    return medians.unionByName(_estimated(sets, 1.0).withColumn("det", F.lit(float("inf"))))


def concentrated(rows: DataFrame, sizes: DataFrame, current: DataFrame, share: float) -> DataFrame:
    """One step from each of the estimates: those of the ``share`` of rows nearest to it."""
    # The nearest share of a normal sample is narrower than the whole.
    correction = share / chi2_below(chi2_quantile(share, P), P + 2)
    near = rows.join(current.select("group", "start", "centre", "inverse"), "group")
    cell = F.floor(50 * F.log(F.greatest(_distance(_x(), F.col("centre"), F.col("inverse")), F.lit(0.0)) + 1e-6))
    cells = _moments(near.withColumn("cell", cell), "group", "start", "cell")
    before = Window.partitionBy("group", "start").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    kept = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(sizes, "group")
    kept = kept.where(F.col("before") < F.ceil(F.col("size") * share))
    sums = ["n", *[f"s{i}" for i in range(P)], *[f"p{n}" for n in range(len(PAIRS))]]
    return _estimated(kept.groupBy("group", "start").agg(*[F.sum(c).alias(c) for c in sums]), correction)


def estimates(rows: DataFrame, share: float = SHARE, steps: int = STEPS) -> DataFrame:
    """``rows`` (group, x0, x1, …) to one row per group: the estimate of least determinant."""
    sizes = settled(rows.groupBy("group").agg(F.count(F.lit(1)).alias("size")), "sizes")
    current = settled(starts(rows, sizes), "starts")
    for n in range(TRIAL):
        current = settled(concentrated(rows, sizes, current, share), f"trial{n}")
    best = current.groupBy("group").agg(F.min_by(F.struct("start", "centre", "inverse", "det"), F.struct("det", "start")).alias("b"))
    best = settled(best.select("group", "b.*", F.lit(True).alias("falls")), "best")
    for n in range(steps):
        falling = best.where("falls")
        if falling.isEmpty():
            break
        made = concentrated(rows, sizes, falling, share).select("group", F.struct("centre", "inverse", "det").alias("new"))
        better = F.coalesce(F.col("new.det") < F.col("det") - LEAST_FALL, F.lit(False))
        best = best.join(made, "group", "left").select(
            "group", "start", *[F.when(better, F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in ("centre", "inverse", "det")], better.alias("falls")
        )
        best = settled(best, f"step{n}")
    return best.drop("falls")


def pooled(rows: DataFrame, levels: int, least_rows: int = LEAST_ROWS, **how) -> DataFrame:
    """``rows`` (group, up1, …, x0, x1, …) to one row per group: group, centre, inverse.
    ``up1`` and so on name what a group too small for an estimate is pooled in, one
    after the other; the last is taken whatever its size. All are estimated together."""
    ups = ["group", *[f"up{n}" for n in range(1, levels)]]
    named = [F.concat(F.lit(f"{n}:"), F.col(c)) for n, c in enumerate(ups)]
    groups = settled(rows.groupBy(*ups).agg(F.count(F.lit(1)).alias("n0")), "groups")
    for n in range(1, levels - 1):
        groups = groups.join(groups.groupBy(ups[n]).agg(F.sum("n0").alias(f"n{n}")), ups[n])
    large = [F.when(F.col(f"n{n}") >= least_rows, named[n]) for n in range(levels - 1)]
    taken = settled(groups.select("group", F.coalesce(*large, named[-1]).alias("key")), "taken")
    x = [f"x{i}" for i in range(P)]
    every = rows.select(F.explode(F.array(*named)).alias("key"), *x).join(taken.select("key").distinct(), "key", "left_semi")
    every = settled(every.withColumnRenamed("key", "group"), "rows")
    fitted = estimates(every, **how).withColumnRenamed("group", "key")
    return settled(taken.join(fitted, "key").select("group", "centre", "inverse"), "fitted")


def _grouped(group_cols: tuple[str, ...], stats: Column) -> list[Column]:
    """The group, what it is pooled in (one column less each time), and the vector."""
    names = [F.col(f"`{c}`").cast("string").alias(f"g{i}") for i, c in enumerate(group_cols)]
    keys = [F.to_json(F.struct(*names[:n])) if n else F.lit("{}") for n in range(len(names), -1, -1)]
    return [*[k.alias(f"up{n}" if n else "group") for n, k in enumerate(keys)], *[v.alias(f"x{i}") for i, v in enumerate(_vector(stats))]]


def _judged(rows: DataFrame, fitted: DataFrame, tail: float) -> tuple[DataFrame, Column]:
    """Rows with group, x0, … and stats; the verdict."""
    x = [F.col(f"x{i}") for i in range(P)]
    far = _distance(x, F.col("centre"), F.col("inverse"))
    kept = ~base_failed(F.col("stats")) & (far.isNull() | (far <= chi2_quantile(1 - tail, P)))
    return rows.join(fitted, "group", "left"), kept


def judged(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), tail: float = TAIL, **how
) -> DataFrame:
    """One row per document: id, the counts, ``base_failed``, ``kept`` and the squared ``distance``."""
    inner = tuple(f"g_{i}" for i in range(len(group_cols)))
    stats = docs.select(
        F.col(id_col).alias("id"), *[F.col(f"`{c}`").alias(g) for c, g in zip(group_cols, inner)], statistics(text_col).alias("stats")
    )
    rows = settled(stats.select("id", "stats", *_grouped(inner, F.col("stats"))), "statistics")
    fitted = pooled(rows.where(~base_failed(F.col("stats"))), len(group_cols) + 1, **how)
    joined, kept = _judged(rows, fitted, tail)
    far = _distance([F.col(f"x{i}") for i in range(P)], F.col("centre"), F.col("inverse"))
    return joined.select(
        F.col("id").alias(id_col), *[F.col(f"stats.{c}").alias(c) for c in COUNTS], base_failed(F.col("stats")).alias("base_failed"), kept.alias("kept"), far.alias("distance")
    )


def _counted_rows(at: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some rows at a time: a batch may hold many long texts.
            for start in range(0, len(batch), 1000):
                some = batch.slice(start, 1000)
                made = np.array([counted(t.as_py()) for t in some.column(at)], np.int64)
                yield pa.RecordBatch.from_arrays([*some.columns, *[pa.array(c) for c in made.T]], names=[*some.schema.names, *COUNTS])

    return count


def without_outliers(
    docs: DataFrame, text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), tail: float = TAIL, **how
) -> DataFrame:
    """The documents that are kept, with all their columns. The counts are made
    once and written beside the rows, which are read again where they are judged."""
    # Columns go by their place, so that no name of theirs can clash.
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in plain.schema], *[f"{c} long" for c in COUNTS]])
    counts = settled(plain.mapInArrow(tidied(_counted_rows(names.index(text_col))), schema), "counted")
    groups = tuple(f"c{names.index(c)}" for c in group_cols)
    rows = counts.withColumn("stats", F.struct(*COUNTS))
    rows = rows.select(*plain.columns, "stats", *_grouped(groups, F.col("stats")))
    fitted = pooled(rows.drop(*plain.columns).where(~base_failed(F.col("stats"))), len(group_cols) + 1, **how)
    joined, kept = _judged(rows, fitted, tail)
    return joined.where(kept).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
