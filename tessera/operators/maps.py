"""Maps with a caller's function: Column functions run as plain expressions, others through Arrow, by batches or by whole shards."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.tensor import ShapeError, Tensor


def map_columns(t: Tensor, f: Callable[[Column], Column]) -> Tensor:
    return t.map(f)


def zip_columns(x: Tensor, y: Tensor, f: Callable[[Column, Column], Column]) -> Tensor:
    return x.zip_map(y, f)


def map_batches(t: Tensor, f: Callable[[pd.Series], pd.Series], kind: str = "double") -> Tensor:
    """f of whole batches of elements, as pandas Series of the same length; for functions that no expression can say."""
    return t.map(F.pandas_udf(lambda v: f(v), kind))


def zip_batches(x: Tensor, y: Tensor, f: Callable[[pd.Series, pd.Series], pd.Series], kind: str = "double") -> Tensor:
    return x.zip_map(y, F.pandas_udf(lambda a, b: f(a, b), kind))


@dataclass(frozen=True)
class ShardOp:
    """``forward`` takes the aligned shards of all inputs as arrays and returns one of the same length; ``gradient`` takes the gradient's
    shard, the result's and the inputs', and returns an array for each input. A shard is ``size`` elements from a multiple of it on, the
    last one fewer; the result doesn't depend on partitions, so a function may look at its whole shard."""

    forward: Callable[..., np.ndarray]
    gradient: Callable[..., tuple[np.ndarray, ...]] | None = None
    size: int = 65_536


def apply_shards(f: Callable[..., np.ndarray], size: int, *tensors: Tensor) -> Tensor:
    """f of the aligned shards of ``tensors``: elements meet by place, and each shard is one group of at most ``size`` rows."""
    first, *others = tensors
    if any(t.shape != first.shape for t in others):
        raise ShapeError(f"shapes {' and '.join(str(t.shape) for t in tensors)} differ")
    rows = first.df.select("idx", F.col("v").cast("double").alias("v0"))
    for k, t in enumerate(others, 1):
        rows = rows.join(t.df.select("idx", F.col("v").cast("double").alias(f"v{k}")), "idx")
    names = [f"v{k}" for k in range(len(tensors))]

    def shard(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        got = np.asarray(f(*[table[n].to_numpy() for n in names]), np.float64)
        if got.shape != (table.num_rows,):
            raise ShapeError(f"a shard of {table.num_rows} elements became one of {got.shape}")
        return pa.table({"idx": table["idx"], "v": got})

    dealt = rows.withColumn("shard", F.floor(F.col("idx") / size))
    return Tensor(dealt.groupBy("shard").applyInArrow(shard, "idx long, v double"), first.shape)


def map_shards(op: ShardOp, *tensors: Tensor) -> Tensor:
    return apply_shards(op.forward, op.size, *tensors)


@lru_cache(maxsize=None)
def shard_forward(op: ShardOp) -> Callable[..., Tensor]:
    return lambda *tensors: apply_shards(op.forward, op.size, *tensors)


@lru_cache(maxsize=None)
def shard_slope(op: ShardOp, k: int) -> Callable[..., Tensor]:
    """The gradient of input ``k``, from tensors of the gradient, the result and the inputs."""
    if op.gradient is None:
        raise ValueError("backward of a shard function without a gradient")
    return lambda *tensors: apply_shards(lambda *parts: op.gradient(*parts)[k], op.size, *tensors)
