"""Parallel training layouts as plans over (rank, idx, v): what each layout computes, with Spark doing the running."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import linalg
from tessera.operators.collectives import allgather, allreduce
from tessera.operators.tensor import Tensor


def worker_forward(x: DataFrame, weights: DataFrame, model_size: int) -> DataFrame:
    """x (idx, v) times the weight (k, w) at idx mod model_size; without weights, x as it is."""
    if model_size == 0:
        return x
    return x.withColumn("k", F.pmod("idx", F.lit(model_size))).join(weights, "k").select("idx", (F.col("v") * F.col("w")).alias("v"))


def worker_backward(gradient: DataFrame, weights: DataFrame, model_size: int) -> DataFrame:
    """The weight times the gradient, at each place."""
    return worker_forward(gradient, weights, model_size)


def data_parallel(parts: DataFrame, weights: DataFrame, model_size: int) -> DataFrame:
    """Each rank's part (rank, idx, v) by that rank's weights (rank, k, w)."""
    keyed = parts.withColumn("k", F.pmod("idx", F.lit(model_size)))
    return keyed.join(weights, ["rank", "k"]).select("rank", "idx", (F.col("v") * F.col("w")).alias("v"))


def tensor_parallel(x: DataFrame, columns: DataFrame, rows: DataFrame, size: int, column_size: int, row_size: int) -> tuple[DataFrame, DataFrame]:
    """Column-parallel output of all ranks one after the other, and row-parallel output as the mean over ranks.

    x (idx, v) goes to every rank; columns and rows are the ranks' weights (rank, k, w).
    """
    ranks = columns.select("rank").distinct()
    everywhere = x.crossJoin(F.broadcast(ranks))  # a copy for each rank, as the layout has it
    wide = allgather(data_parallel(everywhere, columns, column_size), size)
    return wide, allreduce(data_parallel(everywhere, rows, row_size), "mean")


def pipeline(t: Tensor, stages: Sequence[Callable[[DataFrame], DataFrame]], batches: int = 4) -> DataFrame:
    """The stages one after the other over micro-batches (batch, idx, v), put together again. Spark runs chained stages as one."""
    out = linalg.micro_batches(t, batches)
    for stage in stages:
        out = stage(out)
    return linalg.concatenate(out)


def sharded_linear(x: DataFrame, weight_shards: DataFrame, bias: DataFrame | None = None) -> DataFrame:
    """Linear layer on gathered shards (rank, i, j, v) of the weights: the gather is a union that the join reads as it is."""
    return linalg.linear_forward(x, weight_shards.select("i", "j", "v"), bias)


def sharded_gradients(per_rank: DataFrame) -> DataFrame:
    """Mean over ranks of gradients (rank, name, i, j, v), biases as well as weights."""
    return per_rank.groupBy("name", "i", "j").agg(F.avg("v").alias("v"))


def expert_parallel(tokens: DataFrame, gates: DataFrame, experts: DataFrame, per_token: int = 1) -> DataFrame:
    """(token, dim, v): each token through its ``per_token`` best experts, weighted by gate and added up.

    tokens (token, dim, v), gates (token, expert, gate), experts (expert, dim, w), an element-wise scale.
    """
    top = gates.groupBy("token").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("gate", (-F.col("expert")).alias("e"))))), 1, per_token).alias("t"))
    chosen = top.select("token", F.explode("t").alias("c")).select("token", (-F.col("c.e")).alias("expert"), F.col("c.gate").alias("gate"))
    return tokens.join(chosen, "token").join(experts, ["expert", "dim"]).groupBy("token", "dim").agg(F.sum(F.col("v") * F.col("w") * F.col("gate")).alias("v"))


def mlp_tensor_parallel(x: DataFrame, fc1: DataFrame, fc2: DataFrame, world: int, hidden: int) -> DataFrame:
    """Logits of a two-layer net with its hidden units dealt over ``world`` ranks: fc1 by columns, fc2 by rows, partial logits added up.

    The sum over ranks equals the unsharded product; a mean would scale it by 1 / world.
    """
    each = -(-hidden // world)
    h = linalg.linear_forward(x, fc1).withColumn("v", F.greatest(F.col("v"), F.lit(0.0))).withColumn("rank", F.floor(F.col("j") / each))
    part = h.join(fc2.select(F.col("i").alias("j"), F.col("j").alias("o"), F.col("v").alias("w")), "j").groupBy("rank", "i", "o").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return part.groupBy("i", F.col("o").alias("j")).agg(F.sum("v").alias("v"))
