"""Vector functions on array<float>, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import EMBED_DIMS
from .arrays import bind


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine100(a: Column, b: Column) -> Column:
    """Cosine similarity times 100, at least 0; 0 for null or zero vectors."""
    lengths = bind(norm(a) * norm(b), lambda n: F.when(n > 0, F.greatest(dot(a, b) / n * 100, F.lit(0.0))))
    return F.coalesce(lengths, F.lit(0.0))


def embedding_problems(v: Column, dims=EMBED_DIMS) -> Column:
    """Problems of an embedding: missing, odd_dimension, all_zero, low_variety (under 5 distinct in the first 100)."""
    return F.filter(
        F.array(
            F.when(v.isNull(), "missing"),
            F.when(~F.size(v).isin(*dims), "odd_dimension"),
            F.when(F.forall(v, lambda x: x == 0), "all_zero"),
            F.when(F.size(F.array_distinct(F.slice(v, 1, 100))) < 5, "low_variety"),
        ),
        lambda x: x.isNotNull(),
    )
