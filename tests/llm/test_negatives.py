"""Hard negatives against brute force: ties, hot labels, odd rows, and brackets that hold."""

import math
import random

import numpy as np

from quillon.llm import negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, v string, rank string"  # the last two clash with names used inside


def brute(rows, anchors, positives=5, negatives=3, scale=256):
    good = {(i, y, tuple(math.floor(scale * float(np.float32(x))) for x in e)) for i, e, y in rows if i is not None and y is not None and e and all(x is not None and math.isfinite(x) for x in e) and len(e) == 4}
    out = set()
    for a, y, q in good:
        if not anchors(a):
            continue
        dot = lambda v: sum(x * z for x, z in zip(q, v, strict=True))  # noqa: E731,B023
        pos = sorted((-dot(v), i) for i, l, v in good if l == y and i != a)[:positives]
        for p, i in pos:
            near = sorted((-dot(v), j) for j, l, v in good if l != y and 50 * -p <= 100 * dot(v) <= 95 * -p)[:negatives]
            out |= {(a, i, k + 1, j, -p, -s) for k, (s, j) in enumerate(near)}
    return out


def made(seed=4, n=900):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        e = [r.choice((-0.5, 0.25, 0.5, 0.75, r.gauss(0, 1))) for _ in range(4)]
        if k % 5 == 0:
            e = [0.5, 0.25, 0.75, 0.5]  # one vector of many rows: ties
        rows.append((k * 3 - 60, e, 0 if r.random() < 0.4 else r.randrange(1, 6)))
    odd = [(7000, None, 1), (7001, [0.1, None, 0.2, 0.3], 1), (7002, [float("nan"), 0.0, 0.0, 0.0], 1), (7003, [float("inf"), 0.0, 0.0, 0.0], 2), (7004, [0.0] * 4, 2), (7005, [0.5] * 4, None), (None, [0.5] * 4, 1), (7006, [], 1), (7007, [0.5] * 3, 1)]
    return [*rows, *odd, rows[3], rows[3], (7050, [0.5] * 4, 9)]


def run(spark, rows, **more):
    table = spark.createDataFrame([(*x, "x", "y") for x in rows], SCHEMA).repartition(3)
    return {tuple(r) for r in H.mined(table, "id % 5 = 0", **more).collect()}


def test_against_brute_force(spark):
    rows = made()
    got = run(spark, rows)
    assert len(got) > 100 and got == brute(rows, lambda i: i % 5 == 0)


def test_small_tiles_and_chunks(spark, monkeypatch):
    for name, value in (("TILE", 100), ("ANCHORS", 30), ("CHUNK", 16), ("BLOCK", 7)):
        monkeypatch.setattr(H, name, value)
    rows = made(9, 500)
    assert run(spark, rows, positives=2, negatives=4) == brute(rows, lambda i: i % 5 == 0, 2, 4)


def test_brackets_hold_and_prune():
    r = np.random.default_rng(3)
    centres = r.integers(-200, 200, (8, 6))
    x = (centres[r.integers(0, 8, 2000)] + r.integers(-9, 10, (2000, 6))).astype(np.int64)
    q = x[:40].astype(np.float64)
    pivots = H.Pivots(x[:500].astype(np.float64), float((x**2).sum(1).max()))
    d, dq = pivots.of_rows(x.astype(np.float64)).astype(np.float32).astype(np.float64), pivots.of_anchors(q).astype(np.float32).astype(np.float64)
    low, high = H.brackets(dq, (q**2).sum(1), d, d, pivots.norm2)
    scores = q @ x.T.astype(np.float64)
    assert (low <= scores).all() and (scores <= high).all()
    best = np.sort(scores, 1)[:, -5]
    assert (high < best[:, None]).mean() > 0.5  # on rows that cluster, most are dropped without a score


def test_large_components_are_exact():
    q, x = np.full((1, 4), (1 << 29) + 1, np.int64), np.full((2, 4), (1 << 29) + 3, np.int64)
    assert H._exact(q, x).tolist() == [[4 * ((1 << 29) + 1) * ((1 << 29) + 3)] * 2]


def test_empty_and_without_negatives(spark):
    assert run(spark, []) == set()
    assert run(spark, [(k, [0.1, 0.2, 0.3, 0.4], 1) for k in range(20)]) == set()
