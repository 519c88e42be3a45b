"""Vector expressions on array columns, in double precision and inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for empty, zero or unequally long vectors, null for a null vector."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0)))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def hadamard(a: Column, b: Column) -> Column:
    """Element-wise product: the bind operation of a vector symbolic architecture."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))


def scale(v: Column, k: float | Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * k)


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v))


def argmax(v: Column) -> Column:
    """0-based place of the first largest element."""
    return F.array_position(v, F.array_max(v)) - 1


def rotate(v: Column, k: int) -> Column:
    """Circular shift to the right by k: the permute operation of a vector symbolic architecture."""
    n = F.size(v)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(v, (F.pmod(i - k, n) + 1).cast("int")))


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction of two token matrices: mean over query tokens of the best cosine; 0 where either is missing."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: cosine(q, d))))
    ok = query.isNotNull() & doc.isNotNull() & (F.size(query) > 0) & (F.size(doc) > 0)
    return F.when(ok, total(best) / F.size(query)).otherwise(0.0)
