"""Operators on small tensors with known results, and properties that hold whatever the shards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar as S
from tessera.functions import text as X
from tessera.operators import linalg, norms, optim, reduce
from tessera.operators.autograd import Node, no_gradients
from tessera.operators.tensor import ShapeError, Tensor
from tessera.sources import generators as G
from tessera.sources import readers, sinks


def values(t: Tensor) -> list:
    return [r["v"] for r in t.df.orderBy("idx").collect()]


def test_element_by_element(spark):
    a, b = G.from_data(spark, [1, 2, 3]), G.from_data(spark, [4, 5, 6])
    assert values(a + b) == [5, 7, 9]
    assert values(a - b)[0] == -3 and values(a * b)[0] == 4
    assert values(a + 100) == [101, 102, 103]
    assert values(-a) == [-1, -2, -3]
    assert values(a > b) == [False] * 3 and values(a < b) == [True] * 3 and values(a.equal_to(a)) == [True] * 3
    assert values(G.from_data(spark, [-2.0, 1.0, 3.0, 7.0]).clamp(0, 5)) == [0, 1, 3, 5]
    assert values(a + G.from_data(spark, 10)) == [11, 12, 13] == values(G.from_data(spark, 10) + a)


def test_division_and_nan(spark):
    x = G.from_data(spark, [1.0, -1.0, 0.0, math.nan])
    got = values(x / 0.0)
    assert got[:2] == [math.inf, -math.inf] and math.isnan(got[2]) and math.isnan(got[3])
    assert math.isnan(values(x.clamp(0, 1))[3])
    row = spark.range(1).select(S.divide_integers(7, 2).alias("a"), S.divide_integers(-7, 2).alias("b"), S.divide_integers(1, 0).alias("c")).first()
    assert tuple(row) == (3, -3, None)


def test_errors(spark):
    a = G.from_data(spark, [1, 2, 3])
    for f in (lambda: a + G.from_data(spark, [1, 2]), lambda: a.reshape(2, 2), lambda: a.transpose(), lambda: reduce.largest(G.zeros(spark, (0,))), lambda: G.from_data(spark, [1, 2], (3,)), lambda: G.from_data(spark, [[1], [2, 3]]), lambda: linalg.matmul_abt(a, a), lambda: reduce.dot(a, G.zeros(spark, (2,)))):
        with pytest.raises(ShapeError):
            f()
    with pytest.raises(ValueError):
        a.clamp(2, 1)
    with pytest.raises(IndexError):
        a.get(3)
    with pytest.raises(MemoryError):
        sinks.to_array(G.zeros(spark, (100,)), most=10)


def test_access(spark):
    t = G.generate(spark, (2, 3, 4), lambda i: i)
    assert t.get((1, 2, 3)) == 23 and t.get(5) == 5 and t.size == 24
    assert G.from_data(spark, 42).item() == 42 and G.from_data(spark, 42).shape == ()
    assert values(t.set((0, 0, 1), -1))[:3] == [0, -1, 2]
    assert values(t.fill(3.0)) == [3.0] * 24
    assert [r["v"] for r in t.head(3).collect()] == [0, 1, 2]
    assert [r["idx"] for r in t.where(t > 20).orderBy("idx").collect()] == [21, 22, 23]


def test_reductions(spark):
    x = G.zeros(spark, (100, 100)).set(0, 1.0).set(1, 2.0)
    assert reduce.total(x).item() == 3 and reduce.mean(x).item() == pytest.approx(0.0003)
    y = G.from_data(spark, [1.0, 3.0, 3.0, 0.5])
    assert tuple(reduce.argmax(y).first()) == (1, 3.0) and tuple(reduce.argmin(y).first()) == (3, 0.5)
    assert reduce.dot(y, y).item() == pytest.approx(19.25)
    assert reduce.any_true(y > 2).first()["v"] and not reduce.all_true(y > 2).first()["v"]
    assert reduce.worst_error(y, y + 0.25).first()["v"] == 0.25


def test_products_and_shapes(spark):
    a = G.from_data(spark, [1, 2, 3, 4, 5, 6], (2, 3))
    b = G.from_data(spark, [1, 0, 1] + [0, 1, 0] + [1, 0, 1] + [0, 1, 0], (4, 3))
    assert values(linalg.matmul_abt(a, b)) == [4, 2, 4, 2, 10, 5, 10, 5]
    assert values(a.transpose().transpose()) == values(a) and values(a.transpose()) == [1, 4, 2, 5, 3, 6]
    assert values(Tensor(linalg.concatenate(linalg.micro_batches(a, 4)), (6,))) == [1, 2, 3, 4, 5, 6]
    rng = np.random.default_rng(0)
    x, w, dy = rng.normal(size=(5, 3)), rng.normal(size=(3, 2)), rng.normal(size=(5, 2))
    cells = lambda m: G.from_data(spark, m.tolist()).cells()
    dense = lambda df, shape: np.array(values(Tensor.of_cells(df, *shape))).reshape(shape)
    bias = spark.createDataFrame([(0, 1.0), (1, -1.0)], "j long, v double")
    assert np.allclose(dense(linalg.linear_forward(cells(x), cells(w), bias), (5, 2)), x @ w + [1, -1])
    dx, dw, db = linalg.linear_backward(cells(x), cells(w), cells(dy))
    assert np.allclose(dense(dx, (5, 3)), dy @ w.T) and np.allclose(dense(dw, (3, 2)), x.T @ dy)
    assert np.allclose([r["v"] for r in db.orderBy("j").collect()], dy.sum(0))


def test_activations_and_losses(spark):
    x = G.from_data(spark, [-1.0, 0.0, 1.0, 2.0])
    assert values(x.map(S.gelu)) == pytest.approx([-0.158808, 0, 0.841192, 1.9546], abs=1e-5)
    assert values(x.map(S.silu)) == pytest.approx([-0.268941, 0, 0.731059, 1.76159], abs=1e-5)
    p = values(norms.softmax(G.from_data(spark, [1.0, 2.0, 3.0, 1.0, 2.0, 3.0])))
    assert p == pytest.approx([0.0450153, 0.122364, 0.33262] * 2, abs=1e-5) and sum(p) == pytest.approx(1)
    n = values(norms.layer_norm(G.from_data(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])))
    assert n == pytest.approx([-1.46385, -0.878309, -0.29277, 0.29277, 0.878309, 1.46385], abs=1e-4)
    loss = norms.cross_entropy(G.from_data(spark, [2.0, 1.0, 0.1, 3.0]), G.from_data(spark, [1.0, 0.0, 0.0, 1.0]))
    assert loss.item() == pytest.approx(1.88711, abs=1e-4)
    rows = norms.softmax_rows(G.from_data(spark, [[1.0, 2.0], [5.0, 5.0]]).cells()).groupBy("i").agg(F.sum("v").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in rows)


def slope(spark, f, data, at, h=1e-5):
    hi, lo = (list(data), list(data))
    hi[at] += h
    lo[at] -= h
    return (f(Node(G.from_data(spark, hi))).value.item() - f(Node(G.from_data(spark, lo))).value.item()) / (2 * h)


@pytest.mark.parametrize("f", [
    lambda x: (x * x).sum(), lambda x: (x / (x * x + 1.0)).sum(), lambda x: ((x - 0.7).relu() * x).mean(), lambda x: abs(x).sum(), lambda x: (x.gelu() - x.silu()).sum(),
    lambda x: x.clamp(-1.0, 1.0).sum(), lambda x: (x.softmax() * x).sum(), lambda x: (x.layer_norm() * x).sum(), lambda x: x.max() - x.min(),
    lambda x: (x.reshape(2, 2).transpose().matmul_abt(x.reshape(2, 2)) * x.reshape(2, 2)).sum(), lambda x: x.dot(x * x),
])
def test_gradients_agree_with_differences(spark, f):
    data = [0.3, -1.4, 2.1, 0.9]
    x = Node(G.from_data(spark, data), True)
    f(x).backward()
    got = {r["idx"]: r["v"] for r in x.grad.df.collect()}
    for at in (0, 1):
        assert got[at] == pytest.approx(slope(spark, f, data, at), abs=1e-4)


def test_gradient_rules(spark):
    a, b = Node(G.from_data(spark, [1.0, 2.0]), True), Node(G.from_data(spark, [3.0, 4.0]), True)
    (a - b).sum().backward()
    assert values(b.grad) == [-1, -1]
    (a - b).sum().backward()
    assert values(a.grad) == [2, 2]
    b.zero_grad()
    assert b.grad is None
    with pytest.raises(ValueError):
        (a * b).backward()
    with no_gradients():
        assert not (a * b).requires_grad
    logits, labels = Node(G.from_data(spark, [2.0, 1.0, 0.1, 3.0]), True), G.from_data(spark, [1.0, 0.0, 0.0, 1.0])
    logits.cross_entropy(labels).backward()
    p = np.exp([2.0, 1.0, 0.1, 3.0]) / np.exp([2.0, 1.0, 0.1, 3.0]).sum()
    assert values(logits.grad) == pytest.approx(p * 2 - [1, 0, 0, 1])


def test_optimisers(spark):
    x = Node(G.from_data(spark, [1.0, 2.0, 3.0, 4.0]), True)
    x.sum().backward()
    assert values(optim.sgd_step(x.value, x.grad, 0.01)) == pytest.approx([0.99, 1.99, 2.99, 3.99])
    state = optim.adam_state(x.value)
    p, state = optim.adam_step(x.value, x.grad, state, 1, lr=0.1)
    p, state = optim.adam_step(p, x.grad, state, 2, lr=0.1)
    assert values(p) == pytest.approx([0.8, 1.8, 2.8, 3.8], abs=1e-5)  # equal gradients: each corrected step is lr


def test_text_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "añb", 1.5), (2, None, None), (3, "x" * 101, 2.5)], "k long, t string, v double")
    assert [r[0] for r in df.orderBy("k").select(X.byte_length("t")).collect()] == [4, 0, 101]
    assert df.where("k = 3").select(X.preview("t")).first()[0] == "x" * 100 + "..."
    assert df.select(X.padded_vocab(27, 4), X.padded_vocab(28, 4)).first()[:] == (28, 32)
    path = str(tmp_path / "t.parquet")
    df.write.parquet(path)
    assert readers.file_info(spark, path) == {"rows": 3, "columns": 3, "names": ["k", "t", "v"]}
    assert sorted(r["v"] for r in readers.column(spark, path, "v").collect()) == [0, 1.5, 2.5]
    assert readers.column(spark, path, "v", where=("k", "lte", 1)).count() == 1
    assert "PushedFilters: [IsNotNull(k), LessThanOrEqual(k,1)]" in readers.column(spark, path, "v", where=("k", "lte", 1))._jdf.queryExecution().toString()
    with pytest.raises(TypeError):
        readers.column(spark, path, "v", "long")
    with pytest.raises(KeyError):
        readers.column(spark, path, "w")
    sinks.save_csv(df.select("k", "v"), str(tmp_path / "csv"), ["a", "b"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b"]
    t = G.generate(spark, (2, 3), lambda i: i)
    assert sinks.to_array(t).tolist() == [[0, 1, 2], [3, 4, 5]] and list(sinks.batches(t, 4)) == [[0, 1, 2, 3], [4, 5]]


def test_noise(spark):
    got = G.randn(spark, (20_000,)).df.agg(F.avg("v"), F.stddev_pop("v")).first()
    assert abs(got[0]) < 0.03 and abs(got[1] - 1) < 0.03
    assert values(G.rand(spark, (5,))) == values(G.rand(spark, (10,)))[:5]
