"""Point reads and updates of tensors on disk."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators.tensor import ShapeError, Tensor
from tessera.sources.zones import Zones


def values(t):
    return [r["v"] for r in t.df.orderBy("idx").collect()]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_reads_and_changes(spark, tmp_path):
    t = Tensor(spark.range(1000).select(F.col("id").alias("idx"), (F.col("id") * 1.0).alias("v")).repartition(3), (10, 100))
    z = Zones.write(t, str(tmp_path / "t"), zone=100)
    base = files(tmp_path / "t" / "base")
    assert len(base) == 10 and values(z.tensor(spark)) == values(t)
    one = z.rows(spark, [512])
    assert len(one.inputFiles()) == 10 and one.collect()[0]["v"] == 512
    filters = one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "zone" in filters
    assert z.get(spark, (5, 12)) == 512 and z.get(spark, 0) == 0
    z.set(spark.createDataFrame([(512, -1.0), (7, -2.0), (7, -3.0)], "idx long, v double"))
    z.set(spark.createDataFrame([(512, -4.0), (999, None)], "idx long, v double"))
    assert files(tmp_path / "t" / "base") == base
    want = [float(i) for i in range(1000)]
    want[512], want[7], want[999] = -4.0, -2.0, None
    assert values(z.tensor(spark)) == want and [z.get(spark, i) for i in (512, 7, 999, 8)] == [-4, -2, None, 8]
    many = {r["idx"]: r["v"] for r in z.rows(spark, list(range(0, 1000)) + [7] * 50).collect()}
    assert [many[i] for i in range(1000)] == want
    z.merge(spark)
    again = files(tmp_path / "t" / "base")
    assert values(z.tensor(spark)) == want and z.changes(spark) is None
    assert sum(p in again for p in base) == 7  # three ranges had changes
    z.merge(spark)
    with pytest.raises(IndexError):
        z.get(spark, 1000)
    with pytest.raises(ShapeError):
        z.set(spark.createDataFrame([(1000, 1.0)], "idx long, v double"))


def test_integers_and_nothing(spark, tmp_path):
    z = Zones.write(Tensor(spark.range(5).select(F.col("id").alias("idx"), F.col("id").alias("v")), (5,)), str(tmp_path / "i"))
    z.set(spark.createDataFrame([(3, 9.0)], "idx long, v double"))
    assert values(z.tensor(spark)) == [0, 1, 2, 9, 4] and z.rows(spark, []).count() == 0
    assert values(Zones.write(z.tensor(spark), str(tmp_path / "j"), 2).tensor(spark)) == [0, 1, 2, 9, 4]
