"""Dense-vector expressions on ``array<float>`` / ``array<double>`` columns (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, let


def dot(a, b) -> Column:
    """Dot product in double precision; null if either side is null."""
    return F.aggregate(F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def finite_vector(v, dims: int | None = None) -> Column:
    """Whether a vector has no null or non-finite component and ``dims`` components (any number but 0)."""
    v = col_(v).cast("array<double>")
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.coalesce(fine, F.lit(False)) & ((F.size(v) == dims) if dims else (F.size(v) > 0))


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(col_(a), F.lit(0.0).cast("double"), lambda acc, v: acc + v.cast("double") * v.cast("double")))


def l2_normalize(a) -> Column:
    """Unit-length copy of a vector; the zero vector stays zero."""
    def scale(v: Column) -> Column:
        return let(l2_norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0))))

    return let(col_(a), lambda v: F.when(v.isNull(), F.lit(None)).otherwise(scale(v)))


def cosine(a, b) -> Column:
    return dot(a, b) / (l2_norm(a) * l2_norm(b))


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<double>")
