"""Softmax, layer normalisation and losses. Statistics of a whole tensor are one row, joined by broadcast."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import online
from tessera.operators.tensor import Tensor

#: Probabilities at or below this take no part in a loss.
TINY = 1e-12


def softmax(t: Tensor) -> Tensor:
    """Over all elements, whatever the axes."""
    x, state = _with_state(t)
    return Tensor(x.crossJoin(state).select("idx", online.probability(F.col("v"), F.col("_top"), F.col("_mass")).alias("v")), t.shape)


def _with_state(t: Tensor) -> tuple[DataFrame, DataFrame]:
    """The elements as doubles, and one row with the largest and the sum of exponentials below it."""
    x = t.df.select("idx", F.col("v").cast("double").alias("v"))
    state = online.states(x.withColumn("_key", F.lit(0).cast("long")), "_key")
    return x, F.broadcast(state.select(F.col("top").alias("_top"), F.col("mass").alias("_mass")))


def softmax_rows(cells: DataFrame) -> DataFrame:
    """(i, j, v) with each row's v made to add up to 1. Only states of rows are shuffled for the statistics (``online.states``)."""
    x = cells.select("i", "j", F.col("v").cast("double").alias("v"))
    return x.join(online.states(x), "i").select("i", "j", online.probability(F.col("v"), F.col("top"), F.col("mass")).alias("v"))


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is computed once, however often ``then`` and the lambdas in it name it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def softmax_array(x):
    """Softmax of an array column, inside the row: no shuffle. The largest value and the sum are computed once for each row."""
    x = F.transform(x, lambda v: v.cast("double"))
    e = _once(F.struct(x.alias("x"), F.array_max(x).alias("top")), lambda s: F.transform(s["x"], lambda v: F.exp(v - s["top"])))
    e = _once(e, lambda e: F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda s, p: s + p).alias("sum")))
    return _once(e, lambda s: F.transform(s["e"], lambda v: v / s["sum"]))


def layer_norm(t: Tensor, eps: float = 1e-5) -> Tensor:
    """Over all elements: less the mean, over the root of the population variance plus eps."""
    x = t.df.select("idx", F.col("v").cast("double").alias("v"))
    stats = x.agg(F.avg("v").alias("_mean"), F.var_pop("v").alias("_var"))
    return Tensor(x.crossJoin(F.broadcast(stats)).select("idx", ((F.col("v") - F.col("_mean")) / F.sqrt(F.col("_var") + eps)).alias("v")), t.shape)


def cross_entropy(logits: Tensor, labels: Tensor) -> Tensor:
    """Minus the sum of label times log probability, under one softmax over all logits, however they are dealt out."""
    x, state = _with_state(logits)
    v, top, mass = F.col("v"), F.col("_top"), F.col("_mass")
    scored = x.crossJoin(state).select("idx", F.when(online.probability(v, top, mass) > TINY, online.log_probability(v, top, mass)).alias("l"))
    terms = scored.join(labels.df.select("idx", F.col("v").alias("y")), "idx").where("l IS NOT NULL")
    return Tensor(terms.agg(F.coalesce(F.sum(-F.col("y") * F.col("l")), F.lit(0.0)).alias("v")).select(F.lit(0).cast("long").alias("idx"), "v"), ())


def cross_entropy_index(probabilities: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean of minus log probability of each row's class: probabilities (i, j, v), targets (i, j)."""
    return probabilities.join(targets, ["i", "j"]).agg((-F.avg(F.log("v"))).alias("loss"))


def logit_loss(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """As ``cross_entropy_index`` of the softmax of ``cells`` (i, j, v), but from the logits: finite where a probability is too small for
    a double. One logit of each row meets the row's state; no probabilities are made."""
    x = cells.select("i", "j", F.col("v").cast("double").alias("v"))
    met = x.join(targets, ["i", "j"]).join(online.states(x), "i")
    return met.agg((-F.avg(online.log_probability(F.col("v"), F.col("top"), F.col("mass")))).alias("loss"))


def softmax_loss_gradient(probabilities: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """(p - 1 at the class) over the number of rows: the slope of cross_entropy_index by the logits."""
    hit = targets.select("i", F.col("j").alias("_y"))
    return probabilities.join(hit, "i").select("i", "j", ((F.col("v") - (F.col("j") == F.col("_y")).cast("double")) / rows).alias("v"))
