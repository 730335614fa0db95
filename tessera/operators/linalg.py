"""Products, lookups and slices of long-form matrices (i, j, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators.tensor import ShapeError, Tensor

Shape = tuple[int, int, int]


def matmul_abt(a: Tensor, b: Tensor) -> Tensor:
    """A times B transposed, for [M, K] and [N, K]."""
    if len(a.shape) != 2 or len(b.shape) != 2 or a.shape[1] != b.shape[1]:
        raise ShapeError(f"matmul of {a.shape} and {b.shape}")
    cells = blocks.product(a.cells(), b.cells(), (a.shape[0], a.shape[1], b.shape[0]), ("i", "j"), ("i", "j"))
    return Tensor.of_cells(cells, a.shape[0], b.shape[0])


def _shape(shape: Shape | None, x: DataFrame, w: DataFrame) -> Shape:
    """(rows of x, rows of w, columns of w); asked of the frames, in two small jobs, if it isn't given."""
    return shape or (*blocks.extent(x, "i"), *blocks.extent(w, "i", "j"))


def linear_forward(x: DataFrame, w: DataFrame, bias: DataFrame | None = None, shape: Shape | None = None) -> DataFrame:
    """Y = X W + b: x (i, j, v) over inputs j, w (i, j, v) from input i to output j, bias (j, v); ``shape``: rows, inputs, outputs."""
    y = blocks.product(x, w, _shape(shape, x, w))
    if bias is None:
        return y
    return y.join(bias.select("j", F.col("v").alias("_b")), "j").select("i", "j", (F.col("v") + F.col("_b")).alias("v"))


def linear_backward(x: DataFrame, w: DataFrame, dy: DataFrame, shape: Shape | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """dX = dY Wt, dW = Xt dY, db = column sums of dY."""
    rows, inputs, outputs = _shape(shape, x, w)
    dx = blocks.product(dy, w, (rows, outputs, inputs), ("i", "j"), ("i", "j"))
    return dx, of_columns(x, dy, (inputs, rows, outputs)), dy.groupBy("j").agg(F.sum("v").alias("v"))


def of_columns(x: DataFrame, y: DataFrame, shape: Shape | None = None) -> DataFrame:
    """(i, j, v): products of each column i of x (i, j, v) with each column j of y (i, j, v), added up over their rows; ``shape``: columns of
    x, rows, columns of y."""
    columns, rows = blocks.extent(x, "j", "i") if shape is None else shape[:2]
    return blocks.product(x, y, (columns, rows, shape[2] if shape else blocks.extent(y, "j")[0]), ("j", "i"), ("j", "i"))


def embedding_forward(tokens: DataFrame, weights: DataFrame) -> DataFrame:
    """Rows of ``weights`` (token, dim, v) for ``tokens`` (pos, token): (pos, dim, v)."""
    return tokens.join(weights, "token").select("pos", "dim", "v")


def embedding_backward(tokens: DataFrame, dy: DataFrame) -> DataFrame:
    """Gradients (pos, dim, v) added up by token: (token, dim, v)."""
    return tokens.join(dy, "pos").groupBy("token", "dim").agg(F.sum("v").alias("v"))


def extract(t: Tensor, offset: int, count: int) -> Tensor:
    """``count`` elements from ``offset`` on, numbered from 0."""
    inside = t.df.where((F.col("idx") >= offset) & (F.col("idx") < offset + count))
    return Tensor(inside.select((F.col("idx") - offset).alias("idx"), "v"), (count,))


def assemble(shards: DataFrame, offsets: DataFrame) -> DataFrame:
    """``shards`` (shard_id, idx, v) put at their ``offsets`` (shard_id, offset)."""
    return shards.join(offsets, "shard_id").select((F.col("offset") + F.col("idx")).alias("idx"), "v")


def micro_batches(t: Tensor, n: int) -> DataFrame:
    """(batch, idx, v): n runs of equal size; the last takes the rest."""
    each = max(1, t.size // n)
    batch = F.least(F.floor(F.col("idx") / each), F.lit(n - 1))
    return t.df.select(batch.cast("int").alias("batch"), (F.col("idx") - batch * each).alias("idx"), "v")


def concatenate(batches: DataFrame) -> DataFrame:
    """The reverse: (batch, idx, v) in order of batch; sizes are one row for each batch."""
    sizes = batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    other = sizes.select(F.col("batch").alias("_b"), F.col("n").alias("_n"))
    starts = sizes.join(F.broadcast(other), F.col("_b") < F.col("batch"), "left").groupBy("batch").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_start"))
    return batches.join(F.broadcast(starts), "batch").select((F.col("_start") + F.col("idx")).alias("idx"), "v")
