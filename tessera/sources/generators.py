"""Tensors made from numbers, constants and seeded noise."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.operators.tensor import ShapeError, Tensor


def generate(spark: SparkSession, shape: Sequence[int], f: Callable[[Column], Column]) -> Tensor:
    """f of the index at each place."""
    n = math.prod(shape)
    return Tensor(spark.range(n).select(F.col("id").alias("idx"), f(F.col("id")).alias("v")), tuple(shape))


def full(spark: SparkSession, shape: Sequence[int], value: float) -> Tensor:
    return generate(spark, shape, lambda _: F.lit(value))


def zeros(spark: SparkSession, shape: Sequence[int]) -> Tensor:
    return full(spark, shape, 0.0)


def ones(spark: SparkSession, shape: Sequence[int]) -> Tensor:
    return full(spark, shape, 1.0)


def rand(spark: SparkSession, shape: Sequence[int], seed: int = 42) -> Tensor:
    """Uniform in [0, 1); an element depends on its index and the seed only."""
    return generate(spark, shape, lambda i: S.uniform(i, seed))


def randn(spark: SparkSession, shape: Sequence[int], seed: int = 42) -> Tensor:
    return generate(spark, shape, lambda i: S.normal(i, seed))


def from_data(spark: SparkSession, data: Sequence, shape: Sequence[int] | None = None) -> Tensor:
    """Nested lists give their own shape; a flat list takes the one that is given."""
    found: list[int] = []
    level = data
    while isinstance(level, (list, tuple)):
        found.append(len(level))
        level = level[0] if level else None
    flat = [data] if not found else list(data)
    for _ in found[1:]:
        if len({len(x) for x in flat}) > 1:
            raise ShapeError("rows of different length")
        flat = [y for x in flat for y in x]
    shape = tuple(found if shape is None else shape)
    if math.prod(shape) != len(flat):
        raise ShapeError(f"{len(flat)} elements don't fill {shape}")
    kind = "boolean" if flat and isinstance(flat[0], bool) else "long" if flat and isinstance(flat[0], int) else "double"
    frame = pd.DataFrame({"idx": range(len(flat)), "v": flat})
    return Tensor(spark.createDataFrame(frame, f"idx long, v {kind}"), shape)
