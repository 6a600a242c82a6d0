"""Vectors as arrays of doubles: closeness and int8 rows."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankframe.functions.urls import _col

INT8_TOP = 127


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(c: Column | str) -> Column:
    """A vector of length one in the same direction; nought stays nought."""
    v = _col(c).cast("array<double>")
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def length(c: Column | str) -> Column:
    v = _col(c).cast("array<double>")
    return F.sqrt(dot(v, v))


def closeness(a: Column | str, b: Column | str, a_length: Column | str | None = None, b_length: Column | str | None = None) -> Column:
    """The cosine of two vectors; a nought vector is close to nothing. Lengths
    known from before, as of a vector that is in many pairs, are not worked out again."""
    lengths = (length(a) if a_length is None else _col(a_length)) * (length(b) if b_length is None else _col(b_length))
    a, b = _col(a).cast("array<double>"), _col(b).cast("array<double>")
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def quantised(c: Column | str) -> Column:
    """A row as int8 against its own largest component: struct(scale, q).
    Null where a component is not a finite number."""
    v = _col(c).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scale = F.coalesce(F.array_max(F.transform(v, F.abs)), F.lit(0.0)) / INT8_TOP
    q = F.when(scale > 0, F.transform(v, lambda x: F.round(x / scale))).otherwise(F.transform(v, lambda x: F.lit(0.0)))
    return F.when(~bad, F.struct(scale.alias("scale"), q.cast("array<tinyint>").alias("q")))


def dequantised(scale: Column | str, q: Column | str) -> Column:
    scale = _col(scale)
    return F.transform(_col(q), lambda x: x.cast("double") * scale)
