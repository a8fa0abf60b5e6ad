"""Vectors as columns: products, checks, points by id. Searches are those of ``vector_index``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.vector_index import alike, exact_top_k as top_k

__all__ = ["alike", "by_ids", "checked", "cosine", "dot", "top_k"]


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def checked(vectors: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """The same rows; a vector of another size is an error when it is read."""
    return vectors.withColumn(column, F.when(F.size(column) == size, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {size} numbers is wanted, not of "), F.size(column).cast("string")))))


def by_ids(vectors: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """Points of the ids that there are."""
    return vectors.join(ids.select(key).distinct(), key, "left_semi")
