"""Vector arithmetic on array columns (double precision)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_DIM = 384
# Scores are compared after rounding to this many decimals: copies of one
# vector then tie exactly, whichever summation order a task used.
SCORE_DECIMALS = 12


def widen(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(widen(a), widen(b), lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; a zero vector is similar to nothing (0)."""
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.round(F.coalesce(dot(a, b) / F.nullif(lengths, F.lit(0.0)), F.lit(0.0)), SCORE_DECIMALS)


def score_from_distance(distance: Column) -> Column:
    return F.lit(1.0) - distance


def quantise(vector: Column, decimals: int = 6) -> Column:
    """Round each component, as a fixed-decimals text form would."""
    return F.transform(vector, lambda x: F.round(x.cast("double"), decimals).cast("float"))


def dimension(vector: Column, default: int = DEFAULT_DIM) -> Column:
    return F.coalesce(F.nullif(F.size(vector), F.lit(-1)), F.lit(default))


def truncate_dim(vector: Column, dim: int) -> Column:
    """Leading ``dim`` components, rescaled to unit length."""
    head = F.slice(widen(vector), 1, dim)
    length = norm(head)
    return F.transform(head, lambda x: F.coalesce(x / F.nullif(length, F.lit(0.0)), F.lit(0.0)).cast("float"))
