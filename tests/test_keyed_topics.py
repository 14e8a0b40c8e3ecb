"""Rows dealt to partitions by key, with positions of their own."""

from collections import defaultdict
from datetime import datetime

from weirlog.operators import progress
from weirlog.schemas import LOG
from weirlog.streaming import keyed_topics as kt

AT = datetime(2024, 1, 1)


def rows(spark, *given, topic="t"):
    """(key, value, source partition, offset)."""
    data = [
        {"key": k and k.encode(), "value": v.encode(), "topic": topic, "partition": p, "offset": o, "timestamp": AT} for k, v, p, o in given
    ]
    return spark.createDataFrame([tuple(d[c] for c in LOG.names) for d in data], LOG)


def stored(spark, root):
    out = defaultdict(list)
    for r in sorted(kt.read_keyed(spark, root).collect(), key=lambda r: (r.topic, r.partition, r.offset)):
        out[r.topic, r.partition].append((r.offset, r.key and r.key.decode(), r.value.decode()))
    return out


def check(found, parts):
    for (_, part), got in found.items():
        assert 0 <= part < parts
        assert [o for o, _, _ in got] == list(range(len(got)))


def test_positions_are_dense_go_on_and_stay_the_same_when_run_again(spark, place):
    root = place("keyed")
    sink = kt.keyed_topics(root, 3, slices=4)
    keys = ["a", "b", "c", "d", None]
    batches = [rows(spark, *[(keys[i % 5], f"{b}-{i}", i % 4, 1000 * b + 3 * i) for i in range(60)]) for b in range(3)]
    sink(batches[0], 0)
    sink(batches[1], 1)
    before = stored(spark, root)
    sink(batches[1].repartition(5), 1)
    assert stored(spark, root) == before
    sink(batches[2], 2)
    found = stored(spark, root)
    check(found, 3)
    assert sum(map(len, found.values())) == 180
    # a key keeps to one partition and its rows to their order
    for key in "abcd":
        homes = {p for (_, p), got in found.items() for _, k, _ in got if k == key}
        assert len(homes) == 1
        values = [v for got in found.values() for _, k, v in got if k == key]
        assert values == sorted(values, key=lambda v: tuple(map(int, v.split("-"))))
    log = kt.read_keyed(spark, root)
    seeds = log.select(*progress.PARTITION).distinct().selectExpr(*progress.PARTITION, "-1L as frontier")
    ends = {r.partition: r.frontier for r in progress.frontier(log.select(*progress.PARTITION, "offset"), seeds).collect()}
    assert ends == {p: len(got) - 1 for (_, p), got in found.items()}


def test_an_attempt_that_stopped_before_the_ends_were_stored(spark, place):
    root = place("stopped")
    sink = kt.keyed_topics(root, 2)
    sink(rows(spark, ("a", "0", 0, 0), ("a", "1", 0, 1)), 0)
    # the rows of the next batch are there, its ends are not
    again = rows(spark, ("a", "2", 0, 2))
    kt.write_once(kt.placed(again, root, 1, 2), kt.rows_root(root), 1, ["topic"])
    sink(again, 1)
    sink(rows(spark, ("a", "3", 0, 3)), 2)
    assert [v for got in stored(spark, root).values() for _, _, v in got] == ["0", "1", "2", "3"]
    check(stored(spark, root), 2)


def test_a_hot_key_is_spread_and_stays_in_order_per_source_partition(spark, place):
    root = place("hot")
    kt.keyed_topics(root, 4, spread=4)(rows(spark, *[("hot", f"{i % 8}-{i}", i % 8, i) for i in range(400)]), 0)
    found = stored(spark, root)
    check(found, 4)
    assert sorted(len(got) for got in found.values()) == [100, 100, 100, 100]
    for got in found.values():
        for source in {v.split("-")[0] for _, _, v in got}:
            order = [int(v.split("-")[1]) for _, _, v in got if v.startswith(f"{source}-")]
            assert order == sorted(order)


def test_rows_without_keys_repeats_topics_and_nothing_at_all(spark, place):
    root = place("odd")
    sink = kt.keyed_topics(root, 2)
    sink(rows(spark), 0)
    assert kt.ends(root).read(spark).count() == 0
    same = ("a", "same", 0, 5)
    sink(rows(spark, same, same, (None, "n", 0, 6)).unionByName(rows(spark, same, topic="u")), 1)
    sink(rows(spark), 2)
    sink(rows(spark, same), 3)
    found = stored(spark, root)
    check(found, 2)
    assert sum(len(got) for (t, _), got in found.items() if t == "t") == 4
    assert sum(len(got) for (t, _), got in found.items() if t == "u") == 1
