"""Getting tensors out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.tensor import ShapeError, Tensor


def to_array(t: Tensor, most: int = 10_000_000) -> np.ndarray:
    """The whole tensor on the driver; refused beyond ``most`` elements."""
    if t.size > most:
        raise MemoryError(f"{t.size} elements are more than {most}")
    return t.df.orderBy("idx").toPandas()["v"].to_numpy().reshape(t.shape)


def to_disk(t: Tensor) -> Tensor:
    return Tensor(t.df.persist(StorageLevel.DISK_ONLY), t.shape)


def in_ranges(t: Tensor, parts: int) -> Tensor:
    return Tensor(t.df.repartitionByRange(parts, "idx"), t.shape)


def batches(t: Tensor, n: int = 100) -> Iterator[list]:
    """Elements in order, n at a time, one partition on the driver at once."""
    held: list = []
    for row in t.df.orderBy("idx").select("v").toLocalIterator():
        held.append(row["v"])
        if len(held) == n:
            yield held
            held = []
    if held:
        yield held


def show(t: Tensor, n: int = 20) -> str:
    rows = [r["v"] for r in t.df.orderBy("idx").limit(n).collect()]
    return f"Tensor{list(t.shape)} {rows}" + (" ..." if t.size > n else "")


def save_csv(df: DataFrame, path: str, names: list[str] | None = None) -> None:
    """Numbers with ten significant digits, under a header."""
    if names is not None:
        if len(names) != len(df.columns):
            raise ShapeError(f"{len(names)} names for {len(df.columns)} columns")
        df = df.toDF(*names)
    text = [F.format_string("%.10g", F.col(f"`{c}`")).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes]
    df.select(*text).write.mode("overwrite").option("header", True).csv(path)
