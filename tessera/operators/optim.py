"""Optimiser steps as projections over (idx, v) joined with gradients (idx, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tensor import ShapeError, Tensor


def sgd_step(p: Tensor, g: Tensor, lr: float = 0.01) -> Tensor:
    return p.zip_map(g, lambda x, d: x - lr * d)


def adam_state(p: Tensor) -> DataFrame:
    """(idx, m, s): first and second moments, 0 at the start."""
    return p.df.select("idx", F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))


def adam_step(p: Tensor, g: Tensor, state: DataFrame, step: int, lr: float = 1e-3, beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8) -> tuple[Tensor, DataFrame]:
    """The parameters after step number ``step`` (from 1) and the new state; the moments' bias is corrected for that step."""
    if p.shape != g.shape:
        raise ShapeError(f"shapes {p.shape} and {g.shape} differ")
    rows = p.df.join(g.df.select("idx", F.col("v").alias("g")), "idx").join(state, "idx")
    rows = rows.withColumn("m", beta1 * F.col("m") + (1 - beta1) * F.col("g")).withColumn("s", beta2 * F.col("s") + (1 - beta2) * F.col("g") * F.col("g"))
    move = lr * (F.col("m") / (1 - beta1**step)) / (F.sqrt(F.col("s") / (1 - beta2**step)) + eps)
    return Tensor(rows.select("idx", (F.col("v") - move).alias("v")), p.shape), rows.select("idx", "m", "s")
