"""Random batches, the net's gradient, training and sampling against plain versions."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import charlm


def plain_batch(keys, size, seed):
    order = sorted(keys, key=lambda k: (hashlib.md5(f"{seed}:{'' if k is None else k}".encode()).hexdigest(), k is not None, k))
    return [(d, order[charlm.place(seed, d, len(order))]) for d in range(size)]


@pytest.mark.parametrize(("ordered", "digits"), [(100_000, 3), (5, 1), (1, 2)])
def test_batch_doesn_t_depend_on_partitions(spark, monkeypatch, ordered, digits):
    monkeypatch.setattr(charlm, "ORDERED", ordered)
    monkeypatch.setattr(charlm, "DIGITS", digits)
    keys = list(range(300)) + [None]
    want = plain_batch(keys, 200, 5)
    for cut in (1, 4):
        rows = spark.createDataFrame([(k, "x") for k in keys], "k long, b_ string").repartition(cut)
        assert sorted((r["b"], r["k"]) for r in charlm.random_batch(rows, "k", 200, 5).collect()) == want
    assert charlm.random_batch(rows.limit(0), "k", 5).count() == 0 and charlm.random_batch(rows, "k", 0).count() == 0


def test_each_row_is_as_likely(spark):
    rows = spark.range(20)
    seen = Counter(r["id"] for r in charlm.random_batch(rows, "id", 20_000).collect())
    assert len(seen) == 20 and all(abs(n - 1000) < 150 for n in seen.values())


def test_words_and_weights(spark):
    docs = spark.createDataFrame([("Ab ab\tAB-", ), ("x1 7 é",), (None,), ("",)], "text string")
    assert {tuple(r) for r in charlm.lines_of(docs).collect()} == {("ab", 3), ("x", 1)}
    rows = {(tuple(r["tokens"]), r["weight"]) for r in charlm.weighted_rows(charlm.lines_of(docs), 2).collect()}
    assert rows == {((0, 0, 1), 3.0), ((0, 1, 2), 3.0), ((0, 0, 24), 1.0), ((0, 24, 0), 1.0), ((0, 0, 0), 3.0)}  # the line end after two letters is a piece of its own


def batch_of(spark, net, n, seed):
    r = np.random.default_rng(seed)
    tokens, weight = r.integers(0, len(net.wte), (n, net.seq_len + 1)), r.integers(1, 4, n).astype(float)
    return tokens, weight, spark.createDataFrame([(t, w) for t, w in zip(tokens.tolist(), weight.tolist(), strict=True)], "tokens array<int>, weight double").repartition(3)


def test_gradient_agrees_with_differences(spark):
    net = charlm.Net.random(seq_len=3, dim=2, hidden=4, vocab=5)
    tokens, weight, batch = batch_of(spark, net, 50, 1)
    loss, slopes = charlm.gradient(batch, net)
    at = lambda flat: net.like(flat).slopes(tokens, weight)[0] / weight.sum()
    flat = net.flat()
    assert loss == pytest.approx(at(flat))
    for k in range(0, len(flat), 7):
        moved = flat.copy()
        moved[k] += 1e-6
        assert slopes.flat()[k] == pytest.approx((at(moved) - loss) / 1e-6, abs=1e-4)
    assert charlm.loss(batch, net) == pytest.approx(loss)


def test_gradient_of_nothing_and_of_too_much(spark):
    net = charlm.Net.random(seq_len=2, dim=2, hidden=2, vocab=3)
    loss, slopes = charlm.gradient(spark.createDataFrame([], "tokens array<int>, weight double"), net)
    assert math.isnan(loss) and not slopes.flat().any()
    with pytest.raises(MemoryError):
        charlm.gradient(spark.createDataFrame([], "tokens array<int>, weight double"), charlm.Net.random(hidden=40_000))


def test_training_lowers_the_loss(spark):
    rows = charlm.prefix_rows(spark.createDataFrame([("ab",), ("abab",)], "line string"), seq_len=4).select(F.concat_ws(":", "line", "n").alias("key"), "tokens")
    net = charlm.Net.random(seq_len=4, dim=4, hidden=8)
    again, losses = charlm.train(rows, "key", net, steps=4, batch_size=8, lr=0.5)
    assert losses[0] == pytest.approx(math.log(27), abs=0.5) and losses[-1] < losses[0]
    assert again.cells(spark).count() == net.flat().size


def test_training_is_the_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(charlm, "TOGETHER", 2)
    tokens = [[0, 0, 1], [0, 1, 2], [1, 2, 0], [0, 0, 2], [0, 2, 0]]
    net = charlm.Net.random(seq_len=2, dim=3, hidden=4, vocab=3)
    got, losses = charlm.train(spark.createDataFrame(list(enumerate(tokens)), "k long, tokens array<int>"), "k", net, steps=3, batch_size=4, lr=0.3, seed=11)
    drawn, want, seen = [tokens[k] for _, k in plain_batch(range(5), 12, 11)], net, []
    for s in range(3):
        loss, slopes = want.slopes(np.array(drawn[4 * s : 4 * s + 4]), np.ones(4))
        seen.append(loss / 4)
        want = want.like(want.flat() - 0.3 * slopes.flat() / 4)
    assert np.allclose(got.flat(), want.flat()) and np.allclose(losses, seen)


def test_sampling_to_the_end(spark):
    net, draw = charlm.Net.random(seq_len=3, dim=4, hidden=8, vocab=4, seed=3), charlm.mixed(9)

    def plain(i, context, most):
        x, out = ([0, 0, 0] + (context or []))[-3:], []
        while len(out) < most and (not out or out[-1]):
            p = net.probabilities(np.array([x]))[0]
            u, run, token = draw(np.array([i]), len(out))[0], 0.0, len(p) - 1
            for t, y in enumerate(p):
                run += y
                if run >= u:
                    token = t
                    break
            x, out = [*x[1:], token], [*out, token]
        return out

    contexts = [(i, [None, [], [1], [1, 2, 3, 1]][i % 4]) for i in range(60)] + [(-5, [2])]
    for cut in (1, 5):
        got = charlm.sample(spark.createDataFrame(contexts, "id long, tokens array<int>").repartition(cut), net, 8, draw).collect()
        assert {r["id"]: r["tokens"] for r in got} == {i: plain(i, c, 8) for i, c in contexts}
    u = draw(np.arange(100_000), 3)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u, draw(np.arange(100_000), 4))[0, 1]) < 0.02
