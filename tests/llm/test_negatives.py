"""Hard negatives against all pairs."""

import math
import random

import numpy as np
import pytest

from quadlake.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid int, q string"


def brute(rows):
    fit = []
    for i, (vec, e, label, *_) in enumerate(rows):
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        if vec is not None and vec % 7 == 0:
            label = (label + 1) % 10
        fit.append((i, vec, [max(min(math.floor(256 * float(np.float32(x))), negatives.MOST), negatives.LEAST) for x in e], label))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0, x[2])
    out = []
    for i, vec, q, label in fit:
        if vec is None or vec % 100:
            continue
        scored = [(max(min(sum(x * y for x, y in zip(q, p)), negatives.MOST), negatives.LEAST), v, j, other)
                  for j, v, p, other in fit if j != i and len(p) == len(q)]
        for ps, pv, *_ in sorted((s for s in scored if s[3] == label), key=order)[:5]:
            fine = sorted((s for s in scored if s[3] != label and 80 * ps <= 100 * s[0] <= 100 * ps), key=order)[:5]
            out += [(vec, pv, k + 1, v, ps, s) for k, (s, v, *_) in enumerate(fine)]
    return out


def check(spark, rows):
    label = negatives.F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), negatives.F.expr("vec_id % 100 = 0"), label)
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows), key=key)


def vectors(seed, n=900, dim=8, spread=0.4, step=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        v = centres[i % 6] + spread * rng.normal(size=dim)
        rows.append((i * step, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(0, 10)), 1, "x"))
    return rows


@pytest.mark.parametrize("share,batch,step", [(8192, 1024, 512), (100, 8, 16)])
def test_all_pairs_agree(spark, monkeypatch, share, batch, step):
    for name, value in (("SHARE", share), ("BATCH", batch), ("STEP", step), ("MEMBERS", 4), ("GROWTH", 2)):
        monkeypatch.setattr(negatives, name, value)
    rows = vectors(1)
    rows += [(None, rows[3][1], 3, 1, "x"), (3, None, 2, 1, "x"), (200, rows[40][1], None, 1, "x"), (100, [0.0] * 8, 2, 1, "x"),
             (7, [float("nan")] * 8, 1, 1, "x"), (300, [0.1] * 3, 1, 1, "x"), (301, [0.1] * 3, 2, 1, "x"), (303, [0.1] * 3, 1, 1, "x"),
             (400, [], 1, 1, "x"), (402, [], 1, 1, "x"), (403, [], 2, 1, "x"), (-100, rows[9][1], 4, 1, "x"), rows[20], rows[20]]
    check(spark, rows)


def test_many_copies_and_ties(spark, monkeypatch):
    for name, value in (("SHARE", 150), ("BATCH", 4), ("STEP", 32), ("MEMBERS", 2)):
        monkeypatch.setattr(negatives, name, value)
    rng, one = random.Random(2), [0.5, 0.5, -0.5, 0.5]
    rows = [(i * 10, one if i % 3 else [rng.choice([0.5, -0.5, 0.25]) for _ in range(4)], rng.randint(0, 3), 1, "x") for i in range(400)]
    check(spark, rows)


def test_scores_beyond_a_double_and_a_long(spark):
    rng = random.Random(3)
    rows = [(i * 50, [rng.choice([1e30, -1e38, 3.0, 1e14, 5e6]) * rng.random() for _ in range(3)], rng.randint(0, 1), 1, "x") for i in range(60)]
    check(spark, rows)


def test_walks_stop_early_and_lists_are_bounds():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (4000, 4))
    members = x[:20] + rng.integers(-5, 5, (20, 4)) * 0
    centre = members.sum(axis=0) / np.linalg.norm(members.sum(axis=0))
    bound = negatives.bounds(x, members, centre)
    lengths = np.linalg.norm(members, axis=1)
    assert (members @ x.T <= lengths[:, None] * bound[None, :] + 1).all()
    near = np.array([[100, 3, 2, 1], [99, 4, 1, 0]])
    centre = near.sum(axis=0) / np.linalg.norm(near.sum(axis=0))
    seen = []

    def allowed(m, c):
        seen.append(len(c))
        return np.ones((len(m), len(c)), bool)

    high, cut = np.full((2, 1), negatives.MOST), np.full((2, 1), negatives.LEAST)
    m, slot, c, score = negatives.walk(x, np.arange(4000), allowed, near, centre, high, cut, 5)
    assert sum(seen) < 2000
    for k in range(2):
        assert sorted(score[m == k].tolist()) == sorted((near[k] @ x.T).tolist())[-5:]


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(empty, negatives.F.expr("vec_id % 100 = 0"), negatives.F.col("label")).count() == 0
    rows = [(1, [1.0], 2, 1, "x"), (2, [1.0], 2, 1, "x")]
    assert negatives.mine(spark.createDataFrame(rows, SCHEMA), negatives.F.expr("vec_id % 100 = 0"), negatives.F.col("label")).count() == 0
