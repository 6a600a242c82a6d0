"""Running figures over groups of any size.

A plain window sends a whole group to one task, which suits the groups that fit
in one: their rows are shuffled once, by group. A job, a host or a session may
also hold a third of all rows. Each such group is cut into chunks along its own
order, the window runs inside a chunk, and what the earlier chunks of the group
come to is carried over: its rows are shuffled by group *and* chunk.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Groups of more rows than this are cut into chunks.
ROWS_IN_TASK = 100_000


def by_size(
    frame: DataFrame,
    keys: Sequence[str],
    small: Callable[[DataFrame], DataFrame],
    large: Callable[[DataFrame], DataFrame],
    counted: DataFrame | None = None,
) -> DataFrame:
    """What ``small`` makes of the groups that fit in a task, and ``large`` of the
    others. Groups are counted by keys alone, reduced before the shuffle; the keys
    of large ones are few, a hundred-thousandth of the rows at most, so they are broadcast.
    Where the rows cost much to work out, ``counted`` has the same keys for less."""
    counts = (frame if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > ROWS_IN_TASK)
    names = [f"__large{i}" for i in range(len(keys))]
    many = F.broadcast(counts.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]))
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(name))
    return small(frame.join(many, same, "left_anti")).unionByName(large(frame.join(many, same, "left_semi")))


@dataclass(frozen=True)
class Measure:
    """One running figure: ``kind`` is count, sum, max or min."""

    kind: str
    value: Column | None = None
    # False leaves the current row out: what came before it.
    inclusive: bool = True

    def total(self) -> Column:
        if self.kind == "count":
            return F.count(F.lit(1)) if self.value is None else F.count(self.value)
        return getattr(F, self.kind)(self.value)

    def joined(self, carried: Column, local: Column) -> Column:
        if self.kind in ("count", "sum"):
            return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        return F.greatest(carried, local) if self.kind == "max" else F.least(carried, local)

    def over_totals(self, total: Column) -> "Measure":
        """The measure of chunk totals that comes to what the chunks before hold."""
        return Measure("sum" if self.kind == "count" else self.kind, total, inclusive=False)

    def carry(self, total: Column) -> Column:
        return F.sum(total) if self.kind in ("count", "sum") else getattr(F, self.kind)(total)


def running(
    frame: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[Column],
    order: Sequence[str],
    measures: dict[str, Measure],
    descending: bool = False,
    coarser: int = 0,
    level: int = 0,
    then: Callable[[DataFrame], DataFrame] | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add running measures over ``keys`` in ``order``.

    ``chunk`` must never fall as the order rises (a page number, a time bucket,
    an id divided by a constant), and keys and chunk must not be null. Where a
    group may have very many chunks (no keys at all, say), ``coarser`` gathers
    that many values of the first chunk column and carries over those first.
    ``then`` is done to the rows of small groups while they lie by their keys,
    and to those of large ones beside them; ``counted`` is as in ``by_size``.
    """
    then = then or (lambda rows: rows)
    if not keys:
        return then(_chunked(frame, keys, chunk, order, measures, descending, coarser, level))
    return by_size(
        frame, keys,
        lambda rows: then(_whole(rows, keys, chunk, order, measures, descending)),
        lambda rows: then(_chunked(rows, keys, chunk, order, measures, descending, coarser, level)), counted,
    )


def _way(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()


def _whole(
    frame: DataFrame, keys: Sequence[str], chunk: Sequence[Column], order: Sequence[str], measures: dict[str, Measure], descending: bool
) -> DataFrame:
    """Each group in one task, by one sort. As in chunks, nothing is carried to rows without a key or a chunk."""
    marks = [f"__mark_{i}" for i in range(len(chunk))]
    rows = frame.withColumns(dict(zip(marks, chunk)))
    whole = Window.partitionBy(*keys).orderBy(*[_way(c, descending) for c in (*marks, *order)])
    inside = Window.partitionBy(*keys, *marks).orderBy(*[_way(o, descending) for o in order])
    placed = F.lit(True)
    for c in (*keys, *marks):
        placed = placed & F.col(c).isNotNull()

    def running_total(m: Measure) -> Column:
        upto = (Window.unboundedPreceding, Window.currentRow if m.inclusive else -1)
        total = F.when(placed, m.total().over(whole.rowsBetween(*upto))).otherwise(m.total().over(inside.rowsBetween(*upto)))
        return F.coalesce(total, F.lit(0)) if m.kind in ("count", "sum") else total

    return rows.withColumns({n: running_total(m) for n, m in measures.items()}).select(*frame.columns, *measures)


def _chunked(
    frame: DataFrame,
    keys: Sequence[str],
    chunk: Sequence[Column],
    order: Sequence[str],
    measures: dict[str, Measure],
    descending: bool,
    coarser: int,
    level: int,
) -> DataFrame:
    marks = [f"__chunk{level}_{i}" for i in range(len(chunk))]
    rows = frame.withColumns(dict(zip(marks, chunk)))
    part = [*keys, *marks]

    inside = Window.partitionBy(*part).orderBy(*[_way(o, descending) for o in order])
    upto = {
        True: inside.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        False: inside.rowsBetween(Window.unboundedPreceding, -1),
    }
    before = (
        Window.partitionBy(*keys)
        .orderBy(*[_way(m, descending) for m in marks])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = rows.groupBy(*part).agg(*[m.total().alias(f"__total_{n}") for n, m in measures.items()])
    if coarser:
        sums = {f"__carried_{n}": m.over_totals(F.col(f"__total_{n}")) for n, m in measures.items()}
        first = [F.floor(F.col(marks[0]) / coarser)]
        carried = _chunked(totals, keys, first, marks, sums, descending, 0, level + 1)
    else:
        carried = totals.select(
            *part,
            *[m.carry(F.col(f"__total_{n}")).over(before).alias(f"__carried_{n}") for n, m in measures.items()],
        )
    local = rows.withColumns({f"__local_{n}": m.total().over(upto[m.inclusive]) for n, m in measures.items()})
    return local.join(carried, part, "left").select(
        *frame.columns,
        *[m.joined(F.col(f"__carried_{n}"), F.col(f"__local_{n}")).alias(n) for n, m in measures.items()],
    )


def numbered(
    frame: DataFrame, keys: Sequence[str], chunk: Sequence[Column], order: Sequence[str], name: str, coarser: int = 0,
    then: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Number each group's rows 1, 2, 3, … in order."""
    return running(frame, keys, chunk, order, {name: Measure("count")}, coarser=coarser, then=then)


def firsts(frame: DataFrame, keys: Sequence[str | Column], order: Sequence[str]) -> DataFrame:
    """The first row of each group, by aggregation: reduced before the shuffle,
    so a group of copies of any size reaches its task as one row per input task."""
    kept = F.min_by(F.struct(*[F.col(c) for c in frame.columns]), F.struct(*[F.col(o) for o in order]))
    return frame.groupBy(*keys).agg(kept.alias("__kept")).select("__kept.*")
