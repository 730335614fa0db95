"""A tensor as a DataFrame of (idx, v), with its shape on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions import scalar as S


class ShapeError(ValueError):
    """Shapes that an operator can't take together."""


@dataclass(frozen=True)
class Tensor:
    """Elements in row-major order: ``df`` has idx (long, 0 to size - 1) and v. Operators return new tensors and run nothing.

    Tensors that come from the same DataFrame are combined without a join if they were made with ``with_column``; others meet by idx.
    """

    df: DataFrame
    shape: tuple[int, ...]

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    # -- element by element ---------------------------------------------------------------------------------------------------------

    def map(self, f: Callable[[Column], Column]) -> Tensor:
        return Tensor(self.df.select("idx", f(F.col("v")).alias("v")), self.shape)

    def zip_map(self, other: Tensor | float, f: Callable[[Column, Column], Column]) -> Tensor:
        """f of the elements at each place; a number or a tensor of one element without axes goes with every element."""
        if not isinstance(other, Tensor):
            return self.map(lambda v: f(v, F.lit(other)))
        if other.shape == ():
            one = F.broadcast(other.df.select(F.col("v").alias("w")))  # one row
            return Tensor(self.df.crossJoin(one).select("idx", f(F.col("v"), F.col("w")).alias("v")), self.shape)
        if self.shape == ():
            return other.zip_map(self, lambda x, y: f(y, x))
        if self.shape != other.shape:
            raise ShapeError(f"shapes {self.shape} and {other.shape} differ")
        met = self.df.join(other.df.select("idx", F.col("v").alias("w")), "idx")
        return Tensor(met.select("idx", f(F.col("v"), F.col("w")).alias("v")), self.shape)

    def __add__(self, y: Tensor | float) -> Tensor:
        return self.zip_map(y, S.add)

    def __sub__(self, y: Tensor | float) -> Tensor:
        return self.zip_map(y, S.subtract)

    def __mul__(self, y: Tensor | float) -> Tensor:
        return self.zip_map(y, S.multiply)

    def __truediv__(self, y: Tensor | float) -> Tensor:
        return self.zip_map(y, S.divide)

    def __gt__(self, y: Tensor | float) -> Tensor:
        return self.zip_map(y, S.greater_than)

    def __lt__(self, y: Tensor | float) -> Tensor:
        return self.zip_map(y, S.less_than)

    def equal_to(self, y: Tensor | float) -> Tensor:
        return self.zip_map(y, S.equal_to)

    def __neg__(self) -> Tensor:
        return self.map(S.negate)

    def __abs__(self) -> Tensor:
        return self.map(S.absolute)

    def clamp(self, low: float, high: float) -> Tensor:
        S.clamp(0.0, low, high)  # tells of bounds that cross
        return self.map(lambda v: S.clamp(v, low, high))

    # -- single elements ------------------------------------------------------------------------------------------------------------

    def offset(self, at: int | Sequence[int]) -> int:
        """Place in row-major order of an index or of one index for each axis."""
        at = (at,) if isinstance(at, int) and len(self.shape) == 1 else at
        if isinstance(at, int):
            n = at
            if not 0 <= n < self.size:
                raise IndexError(f"{at} is outside of {self.size} elements")
            return n
        if len(at) != len(self.shape) or not all(0 <= i < d for i, d in zip(at, self.shape, strict=True)):
            raise IndexError(f"{tuple(at)} is outside of shape {self.shape}")
        n = 0
        for i, d in zip(at, self.shape, strict=True):
            n = n * d + i
        return n

    def get(self, at: int | Sequence[int]) -> object:
        row: Row | None = self.df.where(F.col("idx") == self.offset(at)).select("v").first()
        return row and row["v"]

    def item(self) -> object:
        if self.size != 1:
            raise ShapeError(f"item of {self.size} elements")
        return self.get(0) if self.shape else self.df.select("v").first()["v"]

    def set(self, at: int | Sequence[int], value: float) -> Tensor:
        n = self.offset(at)
        return Tensor(self.df.select("idx", F.when(F.col("idx") == n, F.lit(value)).otherwise(F.col("v")).alias("v")), self.shape)

    def fill(self, value: float) -> Tensor:
        return self.map(lambda v: F.lit(value).cast("double"))

    def head(self, n: int = 10) -> DataFrame:
        return self.df.orderBy("idx").limit(n)

    def where(self, mask: Tensor) -> DataFrame:
        """The elements at which ``mask`` is true, under their old indexes."""
        if mask.shape != self.shape:
            raise ShapeError(f"shapes {self.shape} and {mask.shape} differ")
        return self.df.join(mask.df.where("v").select("idx"), "idx", "left_semi")

    # -- shape ----------------------------------------------------------------------------------------------------------------------

    def reshape(self, *shape: int) -> Tensor:
        if math.prod(shape) != self.size:
            raise ShapeError(f"{self.size} elements don't fill {shape}")
        return Tensor(self.df, tuple(shape))

    def cells(self) -> DataFrame:
        """(i, j, v) of a matrix."""
        if len(self.shape) != 2:
            raise ShapeError(f"a matrix is asked for, not {self.shape}")
        cols = self.shape[1]
        return self.df.select(F.floor(F.col("idx") / cols).alias("i"), (F.col("idx") % cols).alias("j"), "v")

    @staticmethod
    def of_cells(cells: DataFrame, rows: int, cols: int) -> Tensor:
        return Tensor(cells.select((F.col("i") * cols + F.col("j")).cast("long").alias("idx"), "v"), (rows, cols))

    def transpose(self) -> Tensor:
        cells = self.cells().select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
        return Tensor.of_cells(cells, self.shape[1], self.shape[0])
