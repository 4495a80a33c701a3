"""Vector arithmetic with higher-order array functions, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_FLOOR = 1e-12  # fixed value: shorter vectors are left as they are


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    squares = F.aggregate(
        v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def l2_normalize(v: Column) -> Column:
    length = norm(v)
    return F.when(
        length > NORM_FLOOR, F.transform(v, lambda x: x.cast("double") / length)
    ).otherwise(F.transform(v, lambda x: x.cast("double")))


def has_nan(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x))


def has_inf(v: Column) -> Column:
    return F.exists(v, lambda x: F.abs(x.cast("double")) == float("inf"))


def jaccard(a: Column, b: Column) -> Column:
    """Set overlap of two word arrays; zero when either is empty."""
    union = F.size(F.array_union(a, b))
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / union)


def similarity_from_distance(d: Column, kind: str = "complement") -> Column:
    """``complement``: 1 - d; ``reciprocal``: 1 / (1 + d)."""
    if kind == "complement":
        return 1.0 - d
    if kind == "reciprocal":
        return 1.0 / (1.0 + d)
    raise ValueError(f"unknown score transform: {kind}")
