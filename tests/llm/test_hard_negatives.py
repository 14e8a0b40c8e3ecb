"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from weirlog.llm import hard_negatives as hn


@pytest.mark.parametrize("shape", [(1, 1, 1), (33, 34, 35), (70, 64, 129), (200, 65, 40), (5, 300, 7), (0, 40, 40), (64, 0, 64)])
def test_product(shape):
    rng = np.random.default_rng(1)
    m, k, n = shape
    for bound in (300, 2**62):
        a, b = rng.integers(-bound, bound, (m, k)), rng.integers(-bound, bound, (n, k))
        assert (hn.multiply(a, b) == a @ b.T).all()


def brute(rows, positives=5, negatives=3):
    clean = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        clean.setdefault((i, label, tuple(math.floor(256 * x) for x in v)))
    clean = list(clean)
    out = []
    for a in clean:
        if a[0] % 50:
            continue
        scores = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in clean if b is not a]
        same = sorted((s, i) for s, i, label in scores if label == a[1])[:positives]
        for s, i in same:
            window = sorted((t, j) for t, j, label in scores if label != a[1] and 50 * -s <= 100 * -t <= 95 * -s)
            out += [(a[0], i, rank, j, -s, -t) for rank, (t, j) in enumerate(window[:negatives], 1)]
    return sorted(out)


def vectors(seed, n, labels, dim=7):
    rng = random.Random(seed)
    return [(rng.randrange(n), [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(rng.choice([dim, dim, dim - 2]))], rng.randrange(labels)) for _ in range(n)]


ODD = [
    (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.5], 1), (50, [], 1), (100, [1.0], None), (None, [1.0], 1), (7, None, 1),
    (8, [float("nan")], 1), (9, [float("inf")], 2), (10, [None, 1.0], 2), (11, [1.0, 1.0], 2), (12, [1.0, 1.0], 2), (13, [0.9, 1.0], 3), (-50, [-1.0, 0.0], 3), (14, [], 3),
]


@pytest.mark.parametrize("rows", [vectors(1, 700, 3), vectors(2, 500, 200), [(i, [0.5, 0.25], i % 2) for i in range(300)], ODD, []], ids=["few", "many", "equal", "odd", "none"])
@pytest.mark.parametrize("small", [False, True], ids=["whole", "blocks"])
def test_against_brute_force(spark, monkeypatch, rows, small):
    if small:
        monkeypatch.setattr(hn, "ANCHOR_BYTES", 56 * 3)
        monkeypatch.setattr(hn, "CANDIDATE_BYTES", 56 * 90)
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id bigint, embedding array<float>, label int, n string, bucket int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    got = hn.hard_negatives(table).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_strips(spark, monkeypatch):
    """Heaps filled strip by strip."""
    monkeypatch.setattr(hn, "STRIP", (3, 11))
    rows = [(i, [float(x) for x in np.random.default_rng(i).normal(size=3).astype(np.float32)], i % 3) for i in range(400)]
    heaps = hn.Heaps(2, 3)
    score = np.array([[5, 7, 7, 1], [0, 0, 0, 0]])
    heaps.push(score, np.array([[True, True, True, True], [False, True, False, True]]), np.array([1, 2, 3, 4]), slice(0, 2))
    heaps.push(np.array([[7, 9], [1, 1]]), np.array([[True, False], [True, True]]), np.array([0, 9]), slice(0, 2))
    assert heaps.id.tolist()[0] == [0, 2, 3] and heaps.id[1].tolist() == [0, 9, 2]
    anchors = np.array([r[1] for r in rows[:8]])
    a = np.floor(256 * anchors).astype(np.int64)
    c = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    out = np.zeros((8, 400), np.int64)
    for i, j, s in hn._strips(a, c):
        out[i, j] = s
    assert (out == a @ c.T).all()
