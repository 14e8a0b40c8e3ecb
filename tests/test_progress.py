import random

import pytest

from weirlog.operators import progress

CONFIRMED = "topic string, partition int, offset bigint"
SEEDS = "topic string, partition int, frontier bigint"


def tracked(init, offsets):
    """Plain sequential statement of the rule."""
    have = set(offsets)
    while init + 1 in have:
        init += 1
    return init


def frontier_of(spark, init, offsets, bits):
    confirmed = spark.createDataFrame([("t", 0, o) for o in offsets], CONFIRMED)
    seeds = spark.createDataFrame([("t", 0, init)], SEEDS)
    return progress.frontier(confirmed, seeds, bits).first().frontier


@pytest.mark.parametrize(
    "init, offsets, expected",
    [
        (10, range(-1, 11), 10),
        (10, range(11, 21), 20),
        (20, range(22, 31, 2), 20),
        (20, [*range(22, 31, 2), 21], 22),
        (20, range(21, 31), 30),
        (10, [12, 12, 11, 14, 13], 14),
        (10, [], 10),
        (-1, [0], 0),
        (-1, [1], -1),
        (100, [101, 102, 104, 105, 110], 102),
        (100, [101, 102, 104, 105, 110, 103, 111], 105),
        (61, range(62, 300), 299),
        (62, range(63, 130), 129),
        (63, range(64, 128), 127),
        (0, range(1, 64), 63),
    ],
)
def test_frontier_cases(spark, init, offsets, expected):
    assert frontier_of(spark, init, list(offsets), 1) == expected


def test_frontier_and_held_against_brute_force(spark):
    rng = random.Random(7)
    confirmed, seeds, expected, held = [], [], {}, set()
    for part in range(60):
        init = rng.choice([-1, 0, 5, 63, 64, 127, 200, 511])
        top = init + 1 + rng.choice([0, 1, 63, 64, 130, 700, 1500])
        offsets = [o for o in range(max(0, init - 70), top) if rng.random() > rng.choice([0, 0.001, 0.01])]
        rng.shuffle(offsets)
        confirmed += [("t", part, o) for o in offsets + offsets[:50]]
        if part % 10 != 9:
            seeds.append(("t", part, init))
        elif offsets:
            init = -1
        else:
            continue
        expected[part] = tracked(init, offsets)
        held |= {(part, o) for o in offsets if o > expected[part]}
    have = spark.createDataFrame(confirmed, CONFIRMED)
    start = spark.createDataFrame(seeds, SEEDS)
    for bits in (0, 2, 14):
        got = {r.partition: r.frontier for r in progress.frontier(have, start, bits).collect()}
        assert got == expected
        rows = [(r.partition, r.offset) for r in progress.held_offsets(have, start, bits).collect()]
        assert len(rows) == len(held) and set(rows) == held


def test_resume_decisions(spark):
    ranges = spark.createDataFrame(
        [("t", p, *r) for p, r in enumerate([(0, 0), (5, 9), (5, 9), (5, 9), (5, 9), (5, 9), (5, 9), (5, 9)])],
        "topic string, partition int, oldest bigint, newest bigint",
    )
    saved = spark.createDataFrame(
        [("t", p, s) for p, s in [(0, 7), (2, 2), (3, 8), (4, 9), (5, 6), (6, 0), (7, 4)]],
        "topic string, partition int, saved bigint",
    )
    rows = {r.partition: r for r in progress.resume_offsets(ranges, saved).collect()}
    got = {p: (r.first_offset, r.start, r.problem) for p, r in rows.items()}
    assert got == {
        0: (0, -2, None),
        1: (5, -2, None),
        2: (None, None, "rows_lost"),
        3: (9, -1, None),
        4: (9, -1, None),
        5: (7, 7, None),
        6: (1, 1, None),
        7: (None, None, "rows_lost"),
    }
    strict = {r.partition: r.problem for r in progress.resume_offsets(ranges, saved, strict=True).collect()}
    assert strict[6] == "rows_lost" and strict[2] == "rows_lost" and strict[7] is None


def test_starting_offsets_json(spark):
    resume = spark.createDataFrame(
        [("b", 1, 5), ("b", 0, -2), ("a", 0, -1)], "topic string, partition int, start bigint"
    )
    text = progress.starting_offsets(resume).first().starting_offsets
    assert text == '{"a":{"0":-1},"b":{"0":-2,"1":5}}'


def test_frontier_changes(spark):
    rows = spark.createDataFrame(
        [("t", 0, s, f) for s, f in enumerate([10, 10, 12, 12, 15, 15, 15, 16])],
        "topic string, partition int, seq bigint, frontier bigint",
    )
    moved = progress.frontier_changes(rows, "seq", initial=10)
    assert sorted(r.frontier for r in moved.collect()) == [12, 15, 16]
    assert sorted(r.frontier for r in progress.frontier_changes(rows, "seq").collect()) == [10, 12, 15, 16]


def test_frontier_history_against_frontiers_of_each_batch(spark):
    rng = random.Random(4)
    for block, seed in ((4, 1), (16, 2), (1 << 20, 3)):
        rows = [("t", p, o, rng.randrange(5)) for p in range(4) for o in range(60) if rng.random() < (0.97 if p else 1.0)]
        rows += rng.sample(rows, 20) + [("t", 0, o, 4) for o in range(10)]
        start = {0: 5, 1: -1, 2: 17}
        seeds = spark.createDataFrame([("t", p, f) for p, f in start.items()], SEEDS)
        have = spark.createDataFrame(rows, "topic string, partition int, offset bigint, b int")
        got = {(r.partition, r.batch): r.frontier for r in progress.frontier_history(have, seeds, "b", block).collect()}
        want = {}
        for p in range(4):
            at = start.get(p, -1)
            for b in range(5):
                known = {o for _, q, o, c in rows if q == p and c <= b}
                last = at
                while at + 1 in known:
                    at += 1
                if at != last:
                    want[p, b] = at
        assert got == want
