"""Shard plans, collectives, balancing, executors, the character model and streams."""

import math
import os
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import balance, charlm, collectives, executors
from tessera.plans import shards as P
from tessera.sources import generators as G
from tessera.streaming import heartbeats


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_plans(spark):
    assert rows(P.ceil_plan(spark, 100, 4), "rank")[0] == (0, 0, 25) and rows(P.ceil_plan(spark, 100, 4), "rank")[3] == (3, 75, 25)
    assert rows(P.ceil_plan(spark, 10, 4), "rank")[3] == (3, 9, 1)
    plan = rows(P.default_plan(spark, 10_000, 8), "shard_id")
    assert len(plan) == 8 and {r[2] for r in plan} == {1250}
    assert P.default_shards(250, 8) == 2 and P.default_shards(5, 8) == 1
    assert (P.Layout(4, 2, 3, 17).world, P.Layout(4, 2, 3, 17).tp_rank, P.Layout(4, 2, 3, 17).dp_rank, P.Layout(4, 2, 3, 17).pp_rank) == (24, 1, 0, 2)
    assert P.Layout(dp=4, rank=2).dp_rank == 2 and P.Layout(tp=8, rank=3).tp_rank == 3


DEVICE = st.builds(P.Device, st.sampled_from(["CUDA: A", "OpenCL: A/x", "OpenCL: Intel B", "RAM"]), st.sampled_from(["cuda", "opencl", "opengl", "cpu_dense", "cpu_mmap"]), st.floats(0, 10), st.integers(0, 10**6))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**6), st.lists(DEVICE, min_size=1, max_size=5), st.floats(0, 3))
def test_every_element_has_one_shard(n, devices, factor):
    for plan in (P.saturating(n, devices, intel_factor=factor), P.accelerators_first(n, devices)):
        at = 0
        for s in plan:
            assert s.offset == at and s.count > 0
            at += s.count
        assert at == n


def test_saturating():
    devices = [P.Device("CUDA: GeForce", "cuda", 3, 4000), P.Device("OpenCL: GeForce/PCI", "opencl", 9, 4000), P.Device("OpenCL: Intel(R)", "opencl", 1, 2000), P.Device("RAM", "cpu_dense"), P.Device("Disk", "cpu_mmap")]
    assert [(s.device, s.count) for s in P.saturating(2000, devices)] == [("CUDA: GeForce", 900), ("OpenCL: Intel(R)", 450), ("Disk", 650)]


def test_collectives(spark):
    t = G.generate(spark, (10,), lambda i: i * 1.0).df
    parts = collectives.scatter(t, 4, 10)
    assert rows(collectives.allgather(parts, 3), "idx") == rows(t, "idx")
    copies = collectives.broadcast_to(t, 3)
    assert [r[1] for r in rows(collectives.allreduce(copies), "idx")] == [3.0 * i for i in range(10)]
    assert [r[1] for r in rows(collectives.allreduce(copies, "mean"), "idx")] == list(range(10))
    assert collectives.reduce_scatter(copies, 4, 10).where("rank = 1").orderBy("idx").collect()[0]["v"] == 9.0
    assert [r[1] for r in rows(collectives.all_reduce_sum(G.from_data(spark, [1.0, 2.0, 3.0, 4.0]).df), "idx")] == [10.0] * 4
    grid = collectives.rank_grid(spark, 4, 2, 3)
    assert rows(grid.where("rank = 17")) == [(17, 1, 0, 2)]


@pytest.mark.parametrize("k", [1, 3, 7])
def test_shards_don_t_change_results(spark, k):
    t = G.generate(spark, (100,), lambda i: i * 1.0)
    parts = t.df.withColumn("s", P.shard_of(F.col("idx"), 100, k)).groupBy("s").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    assert parts.agg(F.sum("v")).first()[0] == 4950
    assert sorted(r["n"] for r in parts.collect()) == sorted(r["count"] for r in P.even_plan(spark, 100, k).collect())


def workers(spark):
    return spark.createDataFrame([(0, 0.5, 4, 0, True), (1, 0.9, 2, 3, True), (2, 0.9, 1, 1, True), (3, 1.0, 0, 0, False)], "worker_id long, score double, queue long, assigned long, healthy boolean")


def test_choices(spark):
    w = workers(spark)
    assert balance.by_capacity(w).first()[0] == 1
    assert balance.by_connections(w).first()[0] == 2
    assert balance.by_fairness(w).first()[0] == 1 or balance.by_fairness(w).first()[0] == 2
    asks = spark.range(20).withColumnRenamed("id", "shard_id")
    assert [r[1] for r in rows(balance.by_turn(asks, w), "shard_id")][:4] == [0, 1, 2, 0]
    for f in (balance.by_hash, balance.by_two_choices):
        got = rows(f(asks, w), "shard_id")
        assert len(got) == 20 and {x[1] for x in got} <= {0, 1, 2}
    predicted = spark.createDataFrame([(0, 0.0), (1, 50.0), (2, 50.0)], "worker_id long, load double")
    assert balance.by_prediction(w, predicted).first()[0] == 0


def test_fairness_is_the_least_worst(spark):
    w = workers(spark).where("healthy").toPandas()
    worst = {}
    for i in w.itertuples():
        worst[i.worker_id] = max([(i.queue + i.assigned + 1) / i.score] + [(j.queue + j.assigned) / j.score for j in w.itertuples() if j.worker_id != i.worker_id])
    assert balance.by_fairness(workers(spark)).first()[0] == min(worst, key=lambda k: (worst[k], k))


@pytest.mark.parametrize("strategy", ["capacity", "connections", "turn", "hash", "prediction"])
def test_sticky_assignment(spark, strategy):
    asks = spark.createDataFrame([(1, 7, None), (2, 8, None), (3, 7, None), (4, 7, 0), (5, 7, 1), (6, 7, 2)], "at long, shard_id long, failed long")
    got = rows(balance.assign(asks, workers(spark), strategy), "at")
    assert got[0][2] == got[2][2] and got[5][2] == -1
    assert all(x[2] in (0, 1, 2) for x in got[:5]) and got[3][2] != 0 and got[4][2] == 2


def test_experts(spark):
    experts = spark.createDataFrame([(i, 1.0 + i * 7 % 5) for i in range(16)], "expert_id long, load double")
    for args in ({"workers": 8, "nodes": 2, "group_size": 4, "redundant": 4}, {"workers": 6}):
        placed = balance.balance_experts(experts, **args)
        got = placed.toPandas()
        assert set(got.expert_id) == set(range(16)) and not got.duplicated(["expert_id", "worker_id"]).any()
        loads = balance.worker_loads(placed).toPandas().load
        assert loads.max() / loads.min() < 3 and loads.sum() == pytest.approx(sum(1.0 + i * 7 % 5 for i in range(16)))


def test_scores(spark):
    beats = spark.createDataFrame([(1, 1, 0, 1.0), (1, 2, 10, 1.0), (1, 3, 20, 1.0)], "worker_id long, at long, queue long, score double")
    assert balance.smoothed_load(beats).first()["load"] == pytest.approx(0.3 * 20 + 0.7 * 10)
    s = spark.range(1).select(balance.capacity_score(F.lit("cuda"), F.lit(2000), F.lit(1.0), F.lit(2.0), F.lit(50), F.lit(0.5))).first()[0]
    assert s == pytest.approx(0.8 * 0.45 * 0.9 * 0.9)
    alive = spark.range(1).select(balance.alive(F.lit("RUNNING"), F.lit(0), F.lit(29)), balance.alive(F.lit("FAILED"), F.lit(0), F.lit(1)), balance.alive(F.lit("RUNNING"), F.lit(0), F.lit(30))).first()
    assert tuple(alive) == (True, False, False)


def test_executors(spark):
    x = G.from_data(spark, [1.0, 2.0, 3.0]).df
    w = spark.createDataFrame([(r, 0, float(r + 1)) for r in range(4)], "rank int, k long, w double")
    wide, narrow = executors.tensor_parallel(x, w, w, 3, 1, 1)
    assert wide.count() == 12 and [r[1] for r in rows(narrow, "idx")] == [2.5, 5.0, 7.5]
    assert rows(executors.worker_forward(x, w, 0), "idx") == rows(x, "idx")


def test_prefix_rows(spark):
    got = charlm.prefix_rows(spark.createDataFrame([("nation",)], "line string")).orderBy("n").collect()
    assert len(got) == 7 and all(len(r["tokens"]) == 17 for r in got)
    assert got[2]["tokens"] == [0] * 14 + [14, 1, 20] and got[6]["tokens"] == [0] * 10 + [14, 1, 20, 9, 15, 14, 0]
    long = charlm.prefix_rows(spark.createDataFrame([("a" * 20,), ("b" * 16,), ("",)], "line string"))
    assert {tuple(r) for r in long.groupBy("line").count().collect()} == {("a" * 20, 21), ("b" * 16, 17), ("", 1)}


def test_sampling(spark):
    p = spark.createDataFrame([(0, 0, 0.25), (0, 1, 0.25), (0, 2, 0.5)], "i long, j long, v double")
    for u, want in ((0.1, 0), (0.3, 1), (0.99, 2), (2.0, 2)):
        assert charlm.sample_index(p, spark.createDataFrame([(0, u)], "i long, u double")).first()["token"] == want


def test_monitor_stream(spark, tmp_path):
    pd.DataFrame({"worker_id": [1, 1, 2], "at": [1, 2, 1], "load": [10.0, 20.0, 5.0]}).to_parquet(tmp_path / "a.parquet")
    beats = spark.readStream.schema("worker_id long, at long, load double").parquet(str(tmp_path))
    run = heartbeats.monitor(beats).writeStream.format("memory").queryName("monitored").start()
    until = time.time() + 60
    while time.time() < until and spark.table("monitored").count() < 2:
        time.sleep(0.5)
    run.stop()
    assert rows(spark.table("monitored"), "worker_id") == [(1, 13.0, True), (2, 5.0, True)]


def test_late_rows_are_left_out_of_a_file_sink(spark, tmp_path):
    """Windows are written once, when the watermark has passed them; a row that comes after that is left out, one that is a little late isn't."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    batches = [[("01:10", 1.0), ("02:30", 2.0)], [("02:25", 4.0), ("05:00", 8.0)], [("01:20", 100.0), ("04:55", 16.0)], [("09:00", 0.0)], [("09:01", 0.0)]]
    for n, rows_ in enumerate(batches):
        frame = pd.DataFrame({"ts": [pd.Timestamp(f"2024-01-01 {t}:00") for t, _ in rows_], "event_type": "x", "value": [v for _, v in rows_]})
        frame.to_parquet(source / f"{n}.parquet", coerce_timestamps="us")
        os.utime(source / f"{n}.parquet", (n + 1, n + 1))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
    run = heartbeats.windowed(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["start"].hour: (r["n"], r["total"]) for r in spark.read.parquet(out).collect()}
    assert got == {1: (1, 1.0), 2: (2, 6.0), 4: (1, 16.0), 5: (1, 8.0)}
