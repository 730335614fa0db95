"""Reductions: partial on each partition, then final, as Spark's aggregates do it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.tensor import ShapeError, Tensor


def _need(t: Tensor) -> None:
    if t.size == 0:
        raise ShapeError("no elements to choose from")


def total(t: Tensor) -> Tensor:
    return Tensor(t.df.agg(F.sum(F.col("v").cast("double")).alias("v")).select(F.lit(0).cast("long").alias("idx"), "v"), ())


def mean(t: Tensor) -> Tensor:
    return Tensor(t.df.agg(F.avg(F.col("v").cast("double")).alias("v")).select(F.lit(0).cast("long").alias("idx"), "v"), ())


def largest(t: Tensor) -> Tensor:
    """NaN counts as larger than any number."""
    _need(t)
    return Tensor(t.df.agg(F.max("v").alias("v")).select(F.lit(0).cast("long").alias("idx"), "v"), ())


def smallest(t: Tensor) -> Tensor:
    _need(t)
    return Tensor(t.df.agg(F.min("v").alias("v")).select(F.lit(0).cast("long").alias("idx"), "v"), ())


def argmax(t: Tensor) -> DataFrame:
    """(idx, v) of the largest element, the first of several."""
    _need(t)
    return t.df.agg(F.max_by("idx", F.struct("v", -F.col("idx"))).alias("idx"), F.max("v").alias("v"))


def argmin(t: Tensor) -> DataFrame:
    _need(t)
    return t.df.agg(F.min_by("idx", F.struct("v", "idx")).alias("idx"), F.min("v").alias("v"))


def dot(x: Tensor, y: Tensor) -> Tensor:
    if len(x.shape) != 1 or x.shape != y.shape:
        raise ShapeError(f"dot of shapes {x.shape} and {y.shape}")
    return total(x * y)


def dot_arrays(x: Column | str, y: Column | str) -> Column:
    """Dot product of two array columns, inside the row."""
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def any_true(t: Tensor) -> DataFrame:
    return t.df.agg(F.coalesce(F.bool_or("v"), F.lit(False)).alias("v"))


def all_true(t: Tensor) -> DataFrame:
    return t.df.agg(F.coalesce(F.bool_and("v"), F.lit(True)).alias("v"))


def worst_error(x: Tensor, y: Tensor) -> DataFrame:
    """The largest absolute difference."""
    return x.zip_map(y, lambda a, b: F.abs(a - b)).df.agg(F.max("v").alias("v"))


def length_statistics(lengths: DataFrame, length: str = "length") -> DataFrame:
    n = F.col(length)
    return lengths.agg(F.sum(n).alias("total"), F.max(n).alias("longest"), F.min(n).alias("shortest"), F.avg(n).alias("mean"))


def length_histogram(lengths: DataFrame, length: str = "length", width: int = 100) -> DataFrame:
    return lengths.groupBy((F.floor(F.col(length) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def shares(sizes: DataFrame, by: str, n: str = "n") -> DataFrame:
    """Elements by device class, and their part of all in percent. The total is one row, joined by broadcast."""
    each = sizes.groupBy(by).agg(F.sum(n).alias("elements"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("elements").alias("_all")))).select(by, "elements", (100.0 * F.col("elements") / F.col("_all")).alias("percent"))
