"""Vector functions in double precision, on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; -1 beside a zero vector. Norms may be given where they are kept as columns."""
    both = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(-1.0))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The unit mean of the vectors whose mask is 1."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    total = F.aggregate(kept, F.transform(vectors[0], lambda _: F.lit(0.0)), lambda s, x: F.zip_with(s, x["v"], lambda p, q: p + q.cast("double")))
    length = norm(total)
    return F.transform(total, lambda x: x / F.greatest(length, F.lit(1e-12)))
