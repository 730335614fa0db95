"""Tensors on disk whose single elements can be read and set: folders by range of the index, and changes beside them until they are merged."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tensor import ShapeError, Tensor
from tessera.sources.storage import checkpointed

#: Elements of a range, some 16 MB of Parquet.
ZONE = 1 << 20
#: Indexes that are looked up as literals; more are joined.
LITERALS = 1000


def _zoned(df: DataFrame, zone: int) -> DataFrame:
    return df.select(F.col("idx").cast("long"), F.col("v"), F.floor(F.col("idx") / zone).cast("long").alias("zone"))


@dataclass(frozen=True)
class Zones:
    """``path``/base has a folder for each range, ``path``/changes one for each change and range. Partition pruning finds an element's folder
    without a look at the others, and a change adds files of its own: nothing that lies there is written again until ``merge``."""

    path: str
    shape: tuple[int, ...]
    zone: int = ZONE

    @staticmethod
    def write(t: Tensor, path: str, zone: int = ZONE) -> Zones:
        """One file a range, in order of the index."""
        dealt = _zoned(t.df, zone)
        dealt.repartition("zone").sortWithinPartitions("zone", "idx").write.partitionBy("zone").mode("overwrite").parquet(f"{path}/base")
        out = Zones(path, t.shape, zone)
        out._clear(t.df.sparkSession)
        return out

    @property
    def size(self) -> int:
        return Tensor(None, self.shape).size

    def _base(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self._schema(spark)).parquet(f"{self.path}/base")

    def _schema(self, spark: SparkSession) -> str:
        kind = dict(spark.read.parquet(f"{self.path}/base").dtypes)["v"]
        return f"idx long, v {kind}, zone long"

    def _hadoop(self, spark: SparkSession, name: str):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at

    def _clear(self, spark: SparkSession) -> None:
        store, at = self._hadoop(spark, "changes")
        store.delete(at, True)

    def changes(self, spark: SparkSession) -> DataFrame | None:
        """(zone, idx, v): the last change of each element, or None if there are none."""
        store, at = self._hadoop(spark, "changes")
        if not store.exists(at):
            return None
        found = spark.read.schema(f"{self._schema(spark)}, version long").parquet(f"{self.path}/changes")
        return found.groupBy("zone", "idx").agg(F.max(F.struct("version", "v")).alias("last")).select("zone", "idx", F.col("last.v").alias("v"))

    def _merged(self, base: DataFrame, changes: DataFrame | None) -> DataFrame:
        if changes is None:
            return base
        new = changes.select("zone", "idx", F.struct("v").alias("_new"))  # a change to null is a change
        return base.join(new, ["zone", "idx"], "left").select("idx", F.when(F.col("_new").isNull(), F.col("v")).otherwise(F.col("_new.v")).alias("v"), "zone")

    def tensor(self, spark: SparkSession) -> Tensor:
        return Tensor(self._merged(self._base(spark), self.changes(spark)).select("idx", "v"), self.shape)

    def rows(self, spark: SparkSession, at: Sequence[int]) -> DataFrame:
        """(idx, v) of these elements: their ranges' folders and, in those, their row groups are all that is read."""
        wrong = [n for n in at if not 0 <= n < self.size]
        if wrong:
            raise IndexError(f"{wrong[0]} is outside of {self.size} elements")
        changes = self.changes(spark)
        if len(at) <= LITERALS:
            inside = F.col("zone").isin(sorted({n // self.zone for n in at})) & F.col("idx").isin(sorted(set(at)))
            return self._merged(self._base(spark).where(inside), None if changes is None else changes.where(inside)).select("idx", "v")
        wanted = _zoned(spark.createDataFrame([(n, None) for n in sorted(set(at))], "idx long, v double"), self.zone).select("zone", "idx")
        near = lambda df: df.join(F.broadcast(wanted), ["zone", "idx"], "left_semi")
        return self._merged(near(self._base(spark)), None if changes is None else near(changes)).select("idx", "v")

    def get(self, spark: SparkSession, at: int | Sequence[int]) -> object:
        n = Tensor(None, self.shape).offset(at)
        row = self.rows(spark, [n]).first()
        return row and row["v"]

    def set(self, changes: DataFrame) -> None:
        """Sets the elements of ``changes`` (idx, v); of an index that occurs twice the larger value counts. One writer at a time."""
        spark = changes.sparkSession
        outside = changes.where(~F.col("idx").between(0, self.size - 1) | F.col("idx").isNull()).limit(1).count()
        if outside:
            raise ShapeError(f"an index is outside of {self.size} elements")
        store, at = self._hadoop(spark, "changes")
        versions = [int(f.getPath().getName().partition("=")[2]) for f in store.listStatus(at) if "=" in f.getPath().getName()] if store.exists(at) else []
        kind = dict(spark.read.parquet(f"{self.path}/base").dtypes)["v"]
        new = _zoned(changes.select("idx", F.col("v").cast(kind).alias("v")), self.zone).withColumn("version", F.lit(max(versions, default=0) + 1).cast("long"))
        new.repartition("zone").write.partitionBy("version", "zone").mode("append").parquet(f"{self.path}/changes")

    def merge(self, spark: SparkSession) -> None:
        """Writes the ranges that have changes, and only those, anew. If it breaks off, the changes are still there, and merge again."""
        changes = self.changes(spark)
        if changes is None:
            return
        changes = checkpointed(changes)
        zones = changes.select("zone").distinct()
        new = checkpointed(self._merged(self._base(spark).join(F.broadcast(zones), "zone", "left_semi"), changes))  # a row for each range
        write = new.repartition("zone").sortWithinPartitions("zone", "idx").write.option("partitionOverwriteMode", "dynamic")
        write.partitionBy("zone").mode("overwrite").parquet(f"{self.path}/base")
        self._clear(spark)
