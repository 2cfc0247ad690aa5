"""Vectors (arrays of floats): dot product, normalisation, nearest neighbour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(query: Sequence[float], kind: str = "float") -> Column:
    return F.array(*[F.lit(float(x)).cast(kind) for x in query])


def dot(query: Column | Sequence[float], x: Column, kind: str = "float") -> Column:
    """Inner product with a fixed query, summed in double, in the item type; null where x is null or of another length."""
    query = query if isinstance(query, Column) else literal(query, kind)
    products = F.zip_with(query, x, lambda a, b: a.cast("double") * b.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(query) == F.size(x), total).cast(kind)


def square_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))


def norm(x: Column, kind: str = "float") -> Column:
    """x divided by its length; a zero vector gives NaNs."""
    def divided(p: Column) -> Column:
        return F.transform(p["v"], lambda v: F.when(p["size"] == 0, F.lit(float("nan"))).otherwise(F.try_divide(v.cast("double"), p["size"])).cast(kind))

    # A list of one binds the length, which is worked out once for the vector and not for each item.
    return F.transform(F.array(F.struct(x.alias("v"), F.sqrt(square_norm(x)).alias("size"))), divided)[0]


def nearest_neighbor(df: DataFrame, query: Sequence[float], vector: str, position: str, square_norms: str | None = None) -> DataFrame:
    """One row (index): the first position of the vector nearest to query; null of no vectors.  A null vector, or one of another length, raises.

    The least of |v|^2 - 2 q.v, in one pass with map-side minima; the query is a literal, so nothing is joined.
    """
    size = F.col(square_norms).cast("double") if square_norms else square_norm(F.col(vector))
    q = literal(query, "double")
    distance = size - 2 * F.aggregate(F.zip_with(q, F.col(vector), lambda a, b: a * b.cast("double")), F.lit(0.0), lambda s, v: s + v)
    bad = F.raise_error(F.lit(f"nearest_neighbor takes vectors of {len(query)} items, and no nulls")).cast("double")
    distance = F.when(F.coalesce(F.size(vector) == len(query), F.lit(False)), distance).otherwise(bad)
    return df.agg(F.min_by(F.col(position), F.struct(distance, F.col(position))).alias("index"))
