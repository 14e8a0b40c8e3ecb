import random

import pytest

from weirlog.operators import blocks, metrics, outbox


def rows(spark, sizes):
    rng = random.Random(3)
    data = [(k, s, rng.randint(-5, 5)) for k, n in sizes.items() for s in rng.sample(range(n * 3), n)]
    return data, spark.createDataFrame(data, "topic string, seq bigint, delta bigint")


def by_key(data):
    grouped = {}
    for key, seq, delta in sorted(data):
        grouped.setdefault(key, []).append((seq, delta))
    return grouped


def test_numbers_sums_and_previous_values_cross_blocks(spark):
    data, df = rows(spark, {"a": 500, "b": 1, "c": 40})
    numbers, sums, previous = {}, {}, {}
    for key, items in by_key(data).items():
        total, last = 0, None
        for place, (seq, delta) in enumerate(items, 1):
            total += delta
            numbers[key, seq], sums[key, seq], previous[key, seq] = place + 7, total, last
            last = delta
    n = blocks.number_rows(df, ["topic"], "seq", start=7, bits=4)
    assert {(r.topic, r.seq): r.n for r in n.collect()} == numbers
    r = blocks.number_by_range(df, ["topic"], ["seq"], start=7, slices=6)
    assert {(r.topic, r.seq): r.n for r in r.collect()} == numbers
    s = blocks.running_sum(df, ["topic"], "seq", "delta", "total", bits=4)
    assert {(r.topic, r.seq): r.total for r in s.collect()} == sums
    p = blocks.previous_value(df, ["topic"], "seq", "delta", "before", bits=4)
    assert {(r.topic, r.seq): r.before for r in p.collect()} == previous


def test_gate_closes_strictly_above_the_limit(spark):
    steps = [2000] + [-1000, 1000] * 100
    df = spark.createDataFrame(
        [("t", i, d) for i, d in enumerate(steps)], "topic string, seq bigint, delta bigint"
    )
    got = metrics.pending_gate(df, ["topic"], "seq", "delta", 1500, bits=3).orderBy("seq").collect()
    assert [r.pending for r in got] == [2000] + [1000, 2000] * 100
    assert [r.ready for r in got] == [False] + [True, False] * 100
    edge = metrics.pending_gate(df, ["topic"], "seq", "delta", 2000).collect()
    assert all(r.ready for r in edge)


def test_remaining_after_failure(spark):
    df = spark.createDataFrame(
        [("t", i, i // 10, i == 34 or i == 57) for i in range(100)] + [("u", i, i // 10, False) for i in range(30)],
        "topic string, seq bigint, slice bigint, bad boolean",
    )
    left = outbox.remaining_after_failure(df, ["topic"], "seq", "slice", "bad", bits=3)
    assert sorted((r.topic, r.seq) for r in left.collect()) == [("t", i) for i in range(30, 100)]


def test_throughput_steps(spark):
    def step(total):
        at = 10
        while at * 100 < total:
            at *= 10
        while at * 20 < total:
            at *= 2
        return at

    totals = [1, 9, 10, 100, 199, 200, 201, 999, 1000, 1001, 2000, 2001, 4000, 8001, 10_000, 100_000, 100_001, 10**9]
    df = spark.createDataFrame([(t,) for t in totals], "total bigint")
    got = df.selectExpr("total", f"{metrics.checkpoint_step('total')} as step").collect()
    assert {r.total: r.step for r in got} == {t: step(t) for t in totals}


def test_throughput_counts_across_blocks(spark):
    df = spark.createDataFrame([("t", i, 1000 + i * 2) for i in range(150)], "topic string, seq bigint, at bigint")
    got = metrics.throughput_checkpoints(df, "seq", "at", bits=4).orderBy("messages").collect()
    assert [r.messages for r in got] == list(range(10, 151, 10))
    assert [r.elapsed_us for r in got] == [(m - 1) * 2 for m in range(10, 151, 10)]
    assert got[0].per_second == 10 * 1e6 / 18


def test_latency(spark):
    df = spark.createDataFrame(
        [("t", 0, 1, 5), ("t", 0, 2, 10), ("t", 1, 3, 3)], "topic string, partition int, s bigint, r bigint"
    )
    got = {r.partition: r for r in metrics.latency_stats(df, "s", "r").collect()}
    assert (got[0].messages, got[0].total_latency, got[0].mean_latency) == (2, 12, 6.0)
    assert got[1].mean_latency == 0.0


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_sparse_sequences(spark, bits):
    rng = random.Random(3)
    times = rng.sample(range(10**18), 400)
    rows = [(k % 3, t, rng.choice([None, rng.randrange(9)])) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k int, t bigint, v int")
    numbered = blocks.number_rows(df, ["k"], "t", bits=bits)
    summed = blocks.running_sum(numbered, ["k"], "t", "v", "s", bits=bits)
    got = {(r.k, r.t): (r.n, r.s, r.p) for r in blocks.previous_value(summed, ["k"], "t", "v", "p", bits=bits).collect()}
    for k in range(3):
        total, before = 0, None
        for n, (_, t, v) in enumerate(sorted(r for r in rows if r[0] == k), 1):
            total += v or 0
            assert got[k, t] == (n, total, before)
            before = v


def test_null_keys_are_refused(spark):
    for row in [(None, 1), (1, None)]:
        df = spark.createDataFrame([(1, 5), row], "k int, t bigint")
        with pytest.raises(Exception, match="need keys"):
            blocks.number_rows(df, ["k"], "t").collect()
