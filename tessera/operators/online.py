"""Softmax statistics as a state that merges: the largest value, and the sum of exponentials below it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States that a task holds before it merges those of one key, and, merged, before it passes them on.
HELD, MOST = 1 << 16, 1 << 18


def scaled(v: np.ndarray, top: np.ndarray) -> np.ndarray:
    """exp(v - top); of two equal infinities 1 for the lower one, which adds to a sum that stays 0 or NaN as its row is."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(np.isneginf(v), 0.0, np.exp(v - top))


def merged(key: np.ndarray, top: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One state for each key: the largest top, and each mass brought down to it."""
    keys, at = np.unique(key, return_inverse=True)
    most = np.full(len(keys), -np.inf)
    np.maximum.at(most, at, top)
    whole = np.zeros(len(keys))
    np.add.at(whole, at, mass * scaled(top, most[at]))
    return keys, most, whole


def states(cells: DataFrame, key: str = "i", v: str = "v") -> DataFrame:
    """(key, top, mass): for each ``key`` (long) the largest v, and the sum of exp(v - top); nulls are left out.

    Each task makes states of its batches and merges them, so a key is shuffled as a row for each task that has it, whatever its number of
    elements: one exchange, of states. Minus infinity has no mass; a key of nothing else has top minus infinity and mass 0. NaN and plus
    infinity give NaN, as the definition does.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["key", "top", "mass"])

        for b in batches:
            x = b.column(1).to_numpy(zero_copy_only=False)
            new = merged(b.column(0).to_numpy(zero_copy_only=False), x, np.ones(len(x)))
            held = tuple(np.concatenate(p) for p in zip(held, new, strict=True))
            if len(held[0]) > HELD:
                held = merged(*held)
                if len(held[0]) > MOST:
                    yield out()
                    held = tuple(x[:0] for x in held)
        held = merged(*held)
        yield out()

    rows = cells.select(F.col(key).cast("long").alias("key"), F.col(v).cast("double").alias("v")).where("v IS NOT NULL")
    parts = rows.mapInArrow(partial, "key long, top double, mass double")
    each = parts.groupBy("key").agg(F.collect_list(F.struct("top", "mass")).alias("parts"))  # one or a few for each task
    top = F.array_max(F.transform("parts", lambda p: p["top"]))
    return each.select("key", top.alias("top"), "parts").select(F.col("key").alias(key), "top", F.aggregate("parts", F.lit(0.0), lambda s, p: s + down(p["mass"], p["top"], F.col("top"))).alias("mass"))


def down(mass: Column, top: Column, most: Column) -> Column:
    """A mass below ``top`` as one below ``most``."""
    return F.when(top == -float("inf"), mass).otherwise(mass * F.exp(top - most))


def probability(v: Column, top: Column, mass: Column) -> Column:
    """NaN where nothing but minus infinity is."""
    return F.when(mass == 0, math.nan).otherwise(F.exp(v - top) / F.nullif(mass, F.lit(0.0)))


def log_probability(v: Column, top: Column, mass: Column) -> Column:
    """Finite also where the probability is too small for a double."""
    return v - top - F.log(mass)
