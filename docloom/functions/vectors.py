"""Vector arithmetic on array columns, in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    length = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x / F.when(length == 0, F.lit(1.0)).otherwise(length))


def hashed_embedding(tokens: Column, dim: int = 64) -> Column:
    """A deterministic offline embedding: token counts in hashed places, normalised."""
    places = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(dim)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    return normalise(counts)
