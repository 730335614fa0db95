"""Hard negatives against all pairs, with odd inputs, many lists and copies."""

import math

import numpy as np
import pytest

from tessera.llm import hard_negatives

EMB = "vec_id long, embedding array<float>, label int, row int, v string"


def plain(rows):
    known = []
    for at, (i, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        ints = [math.floor(256 * float(np.float32(c))) for c in x]
        known.append((at, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, ints))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))  # noqa: E731, B905
    last = lambda i: (i is None, i or 0)
    out = []
    for at, i, label, x in known:
        if i is None or i % 50:
            continue
        met = sorted(((dot(x, y), j, lab) for bt, j, lab, y in known if bt != at), key=lambda r: (-r[0], last(r[1])))
        for p, j, _ in [r for r in met if r[2] == label][:5]:
            fits = [r for r in met if r[2] != label and 50 * p <= 100 * r[0] <= 95 * p]
            out += [(i, j, k + 1, r[1], p, r[0]) for k, r in enumerate(fits[:3])]
    return sorted(out, key=str)


def mined(spark, rows, cut=3):
    frame = spark.createDataFrame([(i, x, label, 7, "x") for i, x, label in rows], EMB).repartition(cut)
    got = hard_negatives.mine(frame).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    return sorted((tuple(r) for r in got), key=str)


def drawn(n, dim, seed, labels=3, centres=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(centres, dim)) if centres else np.zeros((1, dim))
    return [(i, (base[i % len(base)] + r.normal(size=dim) * (0.1 if centres else 0.3)).tolist(), int(r.integers(labels))) for i in range(n)]


def test_mined_is_all_pairs(spark):
    rows = drawn(400, 6, 1)
    rows += [(500, None, 1), (501, [math.nan] * 6, 1), (550, [1.0, None], 0), (600, [math.inf] * 6, 0), (650, [1.0] * 6, None), (700, [], 1), (750, [0.5, 0.25], 2)]
    rows += [(100, [0.1] * 6, 0), (100, [0.1] * 6, 0), (None, [0.2] * 6, 0), (None, [0.2] * 6, 1), (-50, [-0.3] * 6, 2), (-7, [0.2] * 6, 2)]
    assert mined(spark, rows) == plain(rows)


def test_many_lists_rounds_and_cuts(spark, monkeypatch):
    """Lists, chunks and slices of a few rows; clusters far apart, so that bounds leave lists out; a third of all rows is one vector."""
    monkeypatch.setattr(hard_negatives, "LIST_ROWS", 8)
    monkeypatch.setattr(hard_negatives, "CHUNK_ROWS", 20)
    monkeypatch.setattr(hard_negatives, "SLICE_ANCHORS", 3)
    monkeypatch.setattr(hard_negatives, "VISITS", (1, 3))
    rows = drawn(300, 5, 2, centres=6) + [(1000 + i, [0.3, 0.1, 0.2, 0.4, 0.1], i % 3) for i in range(150)]
    assert mined(spark, rows) == plain(rows)


def test_large_components(spark):
    rows = [(50, [60_000.0, 1.0], 1), (1, [60_000.0, 2.0], 1), (2, [50_000.0, 3.0], 2), (3, [30_001.0, 0.0], 2), (4, [57_000.0, 0.0], 2)]
    assert mined(spark, rows) == plain(rows) and plain(rows)


@pytest.mark.parametrize("rows", [[], [(0, [0.5], 1)], [(1, [0.5], 1), (2, [0.5], 1)], [(0, [], 1), (1, [], 1), (2, [], 2), (7, None, None)], [(0, None, None)]])
def test_little(spark, rows):
    assert mined(spark, rows, 1) == plain(rows)


def test_bounds_hold(spark):
    """No score is above its list's bound, and lists far from every window are not visited."""
    x = np.array([r[1] for r in drawn(200, 4, 3, centres=4)]) * 256
    x = np.floor(x).astype(np.int32)
    centres = hard_negatives.fit(x, 4)
    at = hard_negatives.nearest(x.astype(float), centres)
    radius = np.array([np.sqrt(((x[at == c] - centres[c]) ** 2).sum(1)).max() for c in range(4)])
    bound = x @ centres.T + np.sqrt((x.astype(float) ** 2).sum(1))[:, None] * radius
    assert (hard_negatives.scores(x, x) <= bound[:, at] + 1e-6).all()
    seeking = spark.createDataFrame([(0, 0, 1, bytearray(x[0].tobytes()), [10**9], [2 * 10**9])], hard_negatives.SEEKING)
    assert hard_negatives.visits(seeking, centres, radius, 0, 4).count() == 0
