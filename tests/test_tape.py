"""Gradients of shared and deep graphs, softmax states, block products and shard functions."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import blocks, linalg, maps, norms, online
from tessera.operators import tape as T
from tessera.operators.autograd import Node
from tessera.operators.tensor import ShapeError, Tensor
from tessera.sources import generators as G


def values(t):
    return [r["v"] for r in t.df.orderBy("idx").collect()]


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("LogicalRDD") + plan.count("Relation") + plan.count("Range (")


# -- gradients ------------------------------------------------------------------------------------------------------------------------


def test_equal_expressions_are_one(spark):
    x = Node(G.from_data(spark, [1.0, 2.0]), True)
    assert (x * x + 1.0).expr is (x * x + 1.0).expr and (x * x).expr is not (x + x).expr
    assert x.clamp(0, 1).expr is not x.clamp(0, 2).expr


def test_deep_sharing_reads_its_leaves_once(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("idx"), (F.col("id") / 50).alias("v")).write.parquet(f"{tmp_path}/x")
    x = Node(Tensor(spark.read.parquet(f"{tmp_path}/x"), (50,)), True)
    y = x
    for _ in range(20):
        y = y * y * 0.5 + y * 0.4
    began = time.perf_counter()
    y.sum().backward()
    df = x.grad.df
    assert scans(df) == 1 and time.perf_counter() - began < 30
    a, slope = np.arange(50) / 50, np.ones(50)
    for _ in range(20):
        a, slope = a * a * 0.5 + a * 0.4, slope * (a + 0.4)
    assert np.allclose(values(x.grad), slope)


def test_columns_of_one_frame_meet_without_a_join(spark, tmp_path):
    spark.range(20).select(F.col("id").alias("idx"), (F.col("id") * 1.0).alias("a"), (F.col("id") + 1.0).alias("b")).write.parquet(f"{tmp_path}/x")
    a, b = Node.columns(spark.read.parquet(f"{tmp_path}/x"), 20, "a", "b")
    (a * b / (a + b)).sum().backward()
    x, y = np.arange(20.0), np.arange(20) + 1.0
    assert np.allclose(values(a.grad), (y / (x + y)) ** 2) and np.allclose(values(b.grad), (x / (x + y)) ** 2)
    assert scans(a.grad.df) == 1 and "Join" not in a.grad.df._jdf.queryExecution().optimizedPlan().toString()


def check(f, data, spark, h=1e-5):
    x = Node(G.from_data(spark, data), True)
    f(x).backward()
    got = values(x.grad)
    for at in (len(data) - 1,):
        near = []
        for d in (h, -h):
            moved = list(data)
            moved[at] += d
            near.append(f(Node(G.from_data(spark, moved))).value.item())
        assert got[at] == pytest.approx((near[0] - near[1]) / (2 * h), abs=1e-4)


@pytest.mark.parametrize("f", [
    lambda x: (x / x.sum() * x).sum(), lambda x: (x.softmax() * x).layer_norm().dot(x), lambda x: (x * x.max() + x.mean()).sum(),
    lambda x: ((x.exp() + 1.0).log() * x).mean(), lambda x: -x.softmax().min() * x.max(),
])
def test_numbers_inside_of_graphs(spark, f):
    check(f, [0.3, -1.4, 2.1, 0.9], spark)


def test_products_in_a_row(spark):
    """Each product uses the one before it twice; the plan doesn't double with each."""
    data = [0.3, -0.4, 0.1, 0.9]

    def f(x):
        y = x.reshape(2, 2)
        for _ in range(4):
            y = y.matmul_abt(y) * 0.5
        return y.sum()

    check(f, data, spark)


def test_gradient_shapes(spark):
    x, one = Node(G.from_data(spark, [1.0, 2.0]), True), Node(G.from_data(spark, 3.0), True)
    (x * one).sum().backward()
    assert values(x.grad) == [3, 3] and one.grad.item() == 3
    y = x * 2.0
    y.backward(G.from_data(spark, [1.0, 10.0]))
    assert values(x.grad) == [5, 23] and values(y.grad) == [1, 10]
    with pytest.raises(ShapeError):
        x + Node(G.from_data(spark, [1.0, 2.0, 3.0]))
    with pytest.raises(ShapeError):
        x.reshape(3)


# -- softmax states -------------------------------------------------------------------------------------------------------------------


def cells(spark, rows):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i long, j long, v double").repartition(3)


ROWS = [[1e308, 1e308], [1e308, -1e308], [-math.inf, 0.0], [-math.inf, -math.inf], [700.0, 710.0, -745.0], [0.0], [5.0, math.nan], [-800.0, -801.0]]


def test_softmax_of_extremes(spark):
    got = {(r["i"], r["j"]): r["v"] for r in norms.softmax_rows(cells(spark, ROWS)).collect()}
    with np.errstate(all="ignore"):
        for i, row in enumerate(ROWS):
            x = np.array(row)
            want = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
            assert np.allclose([got[i, j] for j in range(len(row))], want, equal_nan=True), row
    loss = norms.logit_loss(cells(spark, [[-1e6, 0.0], [1e308, 1e308]]), spark.createDataFrame([(0, 0), (1, 1)], "i long, j long")).first()["loss"]
    assert loss == pytest.approx((1e6 + math.log(2)) / 2)


def test_states_need_one_exchange(spark):
    plan = online.states(cells(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(-1000, 1000)), min_size=1, max_size=40), st.integers(1, 5))
def test_states_merge(pairs, cut):
    """Whatever the batches, merged states are the states of all."""
    k, v = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    whole = online.merged(k, v, np.ones(len(k)))
    parts = [online.merged(a, b, np.ones(len(a))) for a, b in zip(np.array_split(k, cut), np.array_split(v, cut), strict=True)]
    again = online.merged(*[np.concatenate(p) for p in zip(*parts, strict=True)])
    assert all(np.allclose(a, b) for a, b in zip(whole, again, strict=True))


# -- products -------------------------------------------------------------------------------------------------------------------------


def dense(df, rows, cols):
    out = np.zeros((rows, cols))
    for b in df.toArrow().to_batches():
        out[b.column("i").to_numpy(), b.column("j").to_numpy()] = b.column("v").to_numpy()
    return out


@pytest.mark.parametrize("shape", [(1100, 300, 1500), (3, 2000, 2), (1, 1, 1), (1025, 5, 3)])
def test_products_over_panels_and_strips(spark, shape):
    m, k, n = shape
    a = spark.range(m * k).select(F.floor(F.col("id") / k).alias("i"), (F.col("id") % k).alias("j"), ((F.col("id") * 7919) % 101 - 50.0).alias("v"))
    b = spark.range(n * k).select(F.floor(F.col("id") / k).alias("i"), (F.col("id") % k).alias("j"), ((F.col("id") * 104729) % 97 - 48.0).alias("v"))
    x, y = dense(a, m, k), dense(b, n, k)
    got = blocks.product(a, b, shape, ("i", "j"), ("i", "j"))
    assert got.count() == m * n and np.array_equal(dense(got, m, n), x @ y.T)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sparse_products(spark):
    r = np.random.default_rng(1)
    pick = lambda n: [(int(i), int(j), float(v)) for i, j, v in zip(r.integers(0, 3000, n), r.integers(0, 500, n), r.integers(-9, 9, n), strict=True)]
    a, b = pick(400), pick(300)
    frame = lambda x: spark.createDataFrame([*x, (5, 5, None)], "i long, j long, v double")
    want: dict = {}
    for i, k, v in a:
        for j, l, w in b:
            if k == l:
                want[i, j] = want.get((i, j), 0) + v * w
    got = {(r["i"], r["j"]): r["v"] for r in blocks.product(frame(a), frame(b), (3000, 500, 3000), ("i", "j"), ("i", "j")).collect()}
    assert {x[0] for x in a} | {5} >= {i for i, _ in got} and all(got[k] == want.get(k, 0) for k in got) and set(want) <= set(got)
    huge = spark.createDataFrame([(0, 0, math.inf), (1, 1, 2.0)], "i long, j long, v double")
    assert {(r["i"], r["j"], r["v"]) for r in blocks.product(huge, huge, (2, 2, 2), ("i", "j"), ("i", "j")).collect()} == {(0, 0, math.inf), (0, 1, 0), (1, 0, 0), (1, 1, 4)}
    assert blocks.product(huge.limit(0), huge, (0, 2, 2)).count() == 0
    assert dense(linalg.of_columns(huge.where("i = 1"), huge.where("i = 1")), 2, 2)[1, 1] == 4


# -- shard functions ------------------------------------------------------------------------------------------------------------------


def test_shard_function_and_its_gradient(spark):
    """A function that looks at its whole shard: less the shard's mean, times the other input."""
    op = maps.ShardOp(lambda x, y: (x - x.mean()) * y, lambda g, out, x, y: (g * y - (g * y).mean(), g * (x - x.mean())), size=4)
    data, other = np.arange(10.0) ** 1.5, np.linspace(-1, 1, 10)
    x, y = Node(Tensor(spark.createDataFrame(list(enumerate(data.tolist())), "idx long, v double").repartition(3), (10,)), True), Node(G.from_data(spark, other.tolist()), True)
    z = x.map_shards(op, y)
    cut = [slice(0, 4), slice(4, 8), slice(8, 10)]
    assert np.allclose(values(z.value), np.concatenate([(data[c] - data[c].mean()) * other[c] for c in cut]))
    (z * z).sum().backward()
    g = [2 * (data[c] - data[c].mean()) * other[c] for c in cut]
    assert np.allclose(values(x.grad), np.concatenate([h * other[c] - (h * other[c]).mean() for h, c in zip(g, cut, strict=True)]))
    assert np.allclose(values(y.grad), np.concatenate([h * (data[c] - data[c].mean()) for h, c in zip(g, cut, strict=True)]))
    with pytest.raises(ValueError):
        Node(G.from_data(spark, [1.0]), True).map_shards(maps.ShardOp(lambda x: x)).sum().backward()
    with pytest.raises(ShapeError):
        maps.map_shards(op, G.from_data(spark, [1.0]), G.from_data(spark, [1.0, 2.0]))


def test_number_of_a_tape(spark):
    assert T.tensor(T.const(2.0)).item() == 2
