"""Products of matrices in long form (i, j, v): by packed blocks dealt over a grid, or by a join where most of the result is empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, or columns, of a panel of the result (8 MB a panel); places of the inner index in a strip; cells of a packed piece.
SIDE, STRIP, PIECE = 1024, 256, 512
#: Pairs of cells in two strips up to which they are multiplied pair by pair, and how many at once; beyond, as dense blocks.
FEW, AT_ONCE = 1 << 20, 1 << 22

PIECES = "side int, outer long, inner long, cells binary"
#: Of a packed cell: row or column inside of its panel, and place inside of its strip.
CELL = np.dtype([("o", np.int16), ("k", np.int16), ("v", np.float64)])
SUMS = "i long, j long, v double"


def packed(cells: DataFrame, outer: str, inner: str, side: int) -> DataFrame:
    """Pieces of at most PIECE cells of one panel and strip each, made in each task of what it reads, without a shuffle: 12 bytes a cell.

    ``outer`` is the index that stays in the product, ``inner`` the one that is summed over.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            o, k = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            order = np.lexsort((k // STRIP, o // SIDE))
            o, k = o[order], k[order]
            cell = np.empty(len(o), CELL)
            cell["o"], cell["k"], cell["v"] = o % SIDE, k % STRIP, b.column(2).to_numpy(zero_copy_only=False)[order]
            where = np.flatnonzero((np.diff(o // SIDE, prepend=-1) != 0) | (np.diff(k // STRIP, prepend=-1) != 0))
            starts = np.concatenate([np.arange(s, e, PIECE) for s, e in zip(where, [*where[1:], len(o)], strict=True)] + [np.zeros(0, np.int64)]).astype(np.int64)
            pieces = [cell[s:e].tobytes() for s, e in zip(starts, [*starts[1:], len(o)], strict=True)]
            at = pa.array(np.full(len(starts), side, np.int32))
            yield pa.RecordBatch.from_arrays([at, pa.array(o[starts] // SIDE), pa.array(k[starts] // STRIP), pa.array(pieces, pa.binary())], ["side", "outer", "inner", "cells"])

    rows = cells.select(F.col(outer).cast("long"), F.col(inner).cast("long"), F.col("v").cast("double")).where("v IS NOT NULL")
    return rows.mapInArrow(pack, PIECES)


def copies(n: int, name: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long"))).alias(name)


class Panel:
    """The part of the result that one task adds up, and the cells of both sides in one strip of the inner index."""

    def __init__(self):
        self.at, self.sums = -1, np.zeros((SIDE, SIDE))
        self.parts: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.there = np.zeros((2, SIDE), bool)  # which rows and columns have been seen

    def put(self, side: int, inner: int, cells: bytes) -> None:
        if inner != self.at:
            self.multiply()
            self.at = inner
        self.parts[side].append(np.frombuffer(cells, CELL))
        self.there[side, self.parts[side][-1]["o"]] = True

    def multiply(self) -> None:
        if all(self.parts):
            a, b = map(np.concatenate, self.parts)
            n = np.bincount(b["k"], minlength=STRIP)
            with np.errstate(invalid="ignore", over="ignore"):
                if n[a["k"]].sum() <= FEW or not (np.isfinite(a["v"]).all() and np.isfinite(b["v"]).all()):
                    self.sparse(a, b[np.argsort(b["k"], kind="stable")], n)
                else:
                    x, y = self.dense(a), self.dense(b)
                    self.sums[: len(x), : len(y)] += x @ y.T
        for p in self.parts:
            p.clear()

    @staticmethod
    def dense(cells: np.ndarray) -> np.ndarray:
        out = np.zeros((int(cells["o"].max()) + 1, STRIP))
        np.add.at(out, (cells["o"], cells["k"]), cells["v"])
        return out

    def sparse(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
        """Pair by pair, so that a cell that isn't there doesn't meet an infinite one. ``b`` is in order of k, with ``n`` cells of each."""
        first, met = np.cumsum(n) - n, n[a["k"]]
        for cut in np.split(np.arange(len(a)), np.flatnonzero(np.diff(np.cumsum(met) // AT_ONCE)) + 1):
            m = met[cut]
            left = np.repeat(cut, m)
            right = np.repeat(first[a["k"][cut]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            np.add.at(self.sums, (a["o"][left], b["o"][right]), a["v"][left] * b["v"][right])

    def cells(self, row: int, col: int, zeros: bool) -> pa.RecordBatch:
        """The elements whose row is in one side and whose column is in the other; ``row`` and ``col`` number the panel."""
        self.multiply()
        i, j = np.nonzero(np.outer(*self.there) if zeros else self.sums)
        return pa.RecordBatch.from_arrays([pa.array(i + row * SIDE), pa.array(j + col * SIDE), pa.array(self.sums[i, j])], ["i", "j", "v"])


def product(a: DataFrame, b: DataFrame, shape: tuple[int, int, int], a_axes: tuple[str, str] = ("i", "j"), b_axes: tuple[str, str] = ("j", "i"), zeros: bool = True) -> DataFrame:
    """(i, j, v): A times B of ``shape`` (rows, inner, columns). The axes name, of each side's columns, the index that stays and the one that
    is summed over, so transposes need no work of their own. Cells that aren't there are 0, those that occur twice add up; the result has
    the rows that A has cells of and the columns that B has, or, without ``zeros``, what isn't 0. Rows and columns are best numbered densely.

    The result is cut into panels. A side's pieces go once to each panel of the other side; a result with few panels is cut along the inner
    index too, as far as there are shuffle partitions, and its parts are added up. In a task the pieces come in order of the inner index, so
    it holds a panel and two strips, however long the inner index is. There is one shuffle of packed pieces, and no row for a pair of cells.
    Panels grow with rows times columns; a large result that is mostly empty is the work of ``sparse_product``.
    """
    rows, inner, cols = shape
    down, across, deep = -(-rows // SIDE), -(-cols // SIDE), -(-inner // STRIP)
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = max(1, min(deep, tasks // max(1, down * across)))
    cut = (F.col("inner") % cuts).cast("int").alias("cut")
    left = packed(a, *a_axes, 0).select("*", cut, F.col("outer").alias("down"), copies(across, "across"))
    right = packed(b, *b_axes, 1).select("*", cut, copies(down, "down"), F.col("outer").alias("across"))
    keys = ["down", "across", "cut"]
    dealt = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "inner")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, panel = None, None
        for batch in batches:
            for *where, side, at, cells in zip(*[batch.column(c).to_pylist() for c in (*keys, "side", "inner", "cells")], strict=True):
                if where != key:
                    if panel:
                        yield panel.cells(*key[:2], zeros)
                    key, panel = where, Panel()
                panel.put(side, at, cells)
        if panel:
            yield panel.cells(*key[:2], zeros)

    parts = dealt.mapInArrow(add_up, SUMS)
    return parts if cuts == 1 else parts.groupBy("i", "j").agg(F.sum("v").alias("v"))


def sparse_product(a: DataFrame, b: DataFrame, a_axes: tuple[str, str] = ("i", "j"), b_axes: tuple[str, str] = ("j", "i")) -> DataFrame:
    """(i, j, v): A times B, only those elements in which a cell of A and one of B meet, with axes as in ``product``.

    The work grows with the pairs of cells that meet and not with the shape, so rows and columns may have any numbers. Cells that occur
    twice are added up first, so that a place of the inner index makes each element once; a place with many cells is split by Spark's
    skewed join. An element whose cells cancel out stays as 0, one in which only nulls meet as null.
    """

    def side(cells: DataFrame, outer: str, inner: str, to: str, v: str) -> DataFrame:
        return cells.groupBy(F.col(inner).cast("long").alias("k"), F.col(outer).cast("long").alias(to)).agg(F.sum(F.col("v").cast("double")).alias(v))

    met = side(a, *a_axes, "i", "x").hint("merge").join(side(b, *b_axes, "j", "y"), "k")
    return met.groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def extent(cells: DataFrame, *axes: str) -> tuple[int, ...]:
    """One more than the largest index of each axis: a small job, for frames that come without a shape."""
    row = cells.agg(*[F.coalesce(F.max(x).cast("long") + 1, F.lit(0)) for x in axes]).first()
    return tuple(row)
