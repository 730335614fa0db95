"""Reading columns as tensors and tables. Only the columns asked for are read, and filters reach the scan."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import byte_length
from tessera.operators.tensor import ShapeError, Tensor

#: Types that a numeric scan takes, by name.
NUMERIC = {"float": T.FloatType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType()}
COMPARE = {"eq": operator.eq, "gt": operator.gt, "lt": operator.lt, "gte": operator.ge, "lte": operator.le}


def file_info(spark: SparkSession, path: str) -> dict[str, object]:
    """Rows (from the footers), columns and their names."""
    df = spark.read.parquet(path)
    return {"rows": df.count(), "columns": len(df.columns), "names": df.columns}


def column(spark: SparkSession, path: str, name: str, kind: str = "double", nulls: str = "zero", where: tuple[str, str, float] | None = None) -> DataFrame:
    """One column of exactly this type, as v. ``nulls``: zero, or keep. ``where``: (column, eq gt lt gte lte, number), pushed to the scan."""
    df = spark.read.parquet(path)
    if name not in df.columns:
        raise KeyError(f"{path} has no column {name}")
    if df.schema[name].dataType != NUMERIC[kind]:
        raise TypeError(f"{name} is {df.schema[name].dataType.simpleString()}, not {kind}")
    if where:
        df = df.where(COMPARE[where[1]](F.col(where[0]), F.lit(where[2])))
    v = F.col(name)
    return df.select((F.coalesce(v, F.lit(0).cast(kind)) if nulls == "zero" else v).alias("v"))


def columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*names)


def text_samples(df: DataFrame, n: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first n texts by key, nulls as empty."""
    return df.select(key, F.coalesce(text, F.lit("")).alias(text)).orderBy(key).limit(n)


def text_lengths(df: DataFrame, text: str = "text") -> DataFrame:
    """Byte lengths as float, nulls as 0."""
    return df.select(byte_length(text).cast("float").alias("length"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType in NUMERIC.values()]


def matrix(df: DataFrame, key: Column | str) -> DataFrame:
    """(i, j, v): the numeric columns of each row, i being ``key``, a dense number from 0, and j the place of the column among them."""
    names = numeric_columns(df)
    if not names:
        raise ShapeError("no numeric columns")
    cells = F.posexplode(F.array(*[F.coalesce(F.col(c).cast("float"), F.lit(0.0).cast("float")) for c in names])).alias("j", "v")
    return df.select((F.col(key) if isinstance(key, str) else key).alias("i"), cells)


def matrix_metadata(df: DataFrame) -> dict[str, object]:
    names = numeric_columns(df)
    return {"rows": df.count(), "columns": len(names), "names": names}


def tensor_of(df: DataFrame, idx: str, value: str) -> Tensor:
    """A column with its dense index (0 to n - 1) as a tensor; counts the rows."""
    return Tensor(df.select(F.col(idx).cast("long").alias("idx"), F.col(value).alias("v")), (df.count(),))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")
