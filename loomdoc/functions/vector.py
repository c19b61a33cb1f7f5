"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length, but for the zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def paired(items: Column, vectors: Column) -> Column:
    """Items with the vectors that came for them, normalised, as structs of item and vector; another number of vectors than of items is an error."""
    both = F.zip_with(items, F.transform(vectors, normalised), lambda i, v: F.struct(i.alias("item"), v.alias("vector")))
    message = F.concat(F.size(vectors).cast("string"), F.lit(" vectors for "), F.size(items).cast("string"), F.lit(" items"))
    return F.when(F.size(items) == F.size(vectors), both).otherwise(F.raise_error(message))
