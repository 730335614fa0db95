"""Collectives over logical ranks: frames of (rank, idx, v) and Spark's exchanges instead of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def allgather(parts: DataFrame, size: int) -> DataFrame:
    """The ranks' parts, ``size`` elements each, one after the other."""
    return parts.select((F.col("rank") * size + F.col("idx")).cast("long").alias("idx"), "v")


def reduce_scatter(parts: DataFrame, world: int, n: int, how: str = "sum") -> DataFrame:
    """(rank, idx, v): the ranks' sum (or mean) of n elements, each rank keeping its slice, numbered from 0."""
    each = -(-n // world)
    whole = allreduce(parts, how)
    return whole.select(F.floor(F.col("idx") / each).cast("int").alias("rank"), (F.col("idx") % each).alias("idx"), "v")


def scatter(t: DataFrame, world: int, n: int) -> DataFrame:
    """(rank, idx, v): slices of one tensor, without any reduction."""
    each = -(-n // world)
    return t.select(F.floor(F.col("idx") / each).cast("int").alias("rank"), (F.col("idx") % each).alias("idx"), "v")


def allreduce(parts: DataFrame, how: str = "sum") -> DataFrame:
    """(idx, v): the sum or mean over ranks at each place."""
    f = {"sum": F.sum, "mean": F.avg}[how]
    return parts.groupBy("idx").agg(f(F.col("v").cast("double")).alias("v"))


def all_reduce_sum(t: DataFrame) -> DataFrame:
    """Every element becomes the sum of all; the sum is one row, joined by broadcast."""
    return t.select("idx").crossJoin(F.broadcast(t.agg(F.sum(F.col("v").cast("double")).alias("v"))))


def broadcast_to(t: DataFrame, world: int) -> DataFrame:
    """(rank, idx, v): a copy for every rank."""
    return t.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(world - 1))))


def exchange(parts: DataFrame, to: Column) -> DataFrame:
    """Send and receive: each row goes to the rank that ``to`` says."""
    return parts.withColumn("rank", to)


def rank_batch(rows: DataFrame, key: str, world: int) -> DataFrame:
    """Row b of the order by ``key`` (a dense number from 0) goes to rank b mod world."""
    return rows.withColumn("rank", F.pmod(F.col(key), F.lit(world)).cast("int"))


def rank_grid(spark: SparkSession, tp: int, dp: int, pp: int) -> DataFrame:
    """(rank, tp_rank, dp_rank, pp_rank): tensor ranks run fastest, pipeline ranks slowest."""
    r = F.col("id")
    return spark.range(tp * dp * pp).select(r.alias("rank"), (r % tp).alias("tp_rank"), (F.floor(r / tp) % dp).alias("dp_rank"), F.floor(r / (tp * dp)).alias("pp_rank"))


def groups(grid: DataFrame) -> DataFrame:
    """``grid`` with the number of the tensor, data and pipeline group of each rank, and the members of its tensor group."""
    dp, tp = F.max("dp_rank").over(Window.partitionBy()) + 1, F.max("tp_rank").over(Window.partitionBy()) + 1
    return grid.withColumn("tp_group", F.col("pp_rank") * dp + F.col("dp_rank")).withColumn("dp_group", F.col("pp_rank") * tp + F.col("tp_rank")).withColumn("pp_group", F.col("dp_rank") * tp + F.col("tp_rank"))
