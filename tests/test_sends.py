"""Send state and ids over batches."""

import pytest

from weirlog.streaming import sends

CHANGE = "topic string, id bigint, state string, at bigint, key binary, value binary"


def change(spark, *rows):
    return spark.createDataFrame([(t, i, s, at, b"k" if s == "new" else None, f"v{i}".encode() if s == "new" else None) for t, i, s, at in rows], CHANGE)


def table(spark, root):
    return {(r.topic, r.id): (r.state, r.sends, r.value) for r in sends.send_table(root).read(spark).collect()}


def test_messages_are_sent_failed_restored_and_acknowledged(spark, place):
    root = place("sends")
    sends.apply_changes(change(spark, *[("t", i, "new", 0) for i in range(1, 6)], ("u", 1, "new", 0)), root, 0)
    for _ in range(2):  # the batch is run twice and picks the same
        picked = {(r.topic, r.id): r.value for r in sends.take(spark, root, 1, count=3).collect()}
        assert picked == {("t", 1): b"v1", ("t", 2): b"v2", ("t", 3): b"v3", ("u", 1): b"v1"}
    answers = change(spark, ("t", 1, "acked", 1), ("t", 2, "failed", 1), ("t", 2, "failed", 2), ("t", 9, "acked", 1))
    assert sends.apply_changes(answers, root, 2).count() == 2
    assert table(spark, root) == {
        ("t", 2): ("failed", 1, b"v2"), ("t", 3): ("sent", 1, b"v3"), ("t", 4): ("new", 0, b"v4"), ("t", 5): ("new", 0, b"v5"), ("u", 1): ("sent", 1, b"v1"),
    }
    # failed rows go first, and by themselves
    assert [(r.topic, r.id) for r in sends.take(spark, root, 3, count=3).collect()] == [("t", 2)]
    sends.restore(spark, root, 4)
    assert sorted(k for k, v in table(spark, root).items() if v[0] == "failed") == [("t", 2), ("t", 3), ("u", 1)]
    # answers that come after all, twice, and after an acknowledgement
    sends.apply_changes(change(spark, ("t", 2, "acked", 5), ("t", 3, "acked", 5), ("u", 1, "acked", 5)), root, 5)
    assert sends.apply_changes(change(spark, ("t", 1, "failed", 6), ("t", 2, "failed", 6), ("t", 3, "acked", 6)), root, 6).count() == 0
    assert table(spark, root) == {("t", 4): ("new", 0, b"v4"), ("t", 5): ("new", 0, b"v5")}


def test_one_batch_may_hold_all_changes_of_a_message(spark, place):
    root = place("whole")
    sends.apply_changes(change(spark, ("t", 1, "new", 0), ("t", 1, "sent", 1), ("t", 1, "failed", 2), ("t", 1, "sent", 3), ("t", 2, "new", 0), ("t", 2, "acked", 1), ("t", 2, "failed", 2)), root, 0)
    assert table(spark, root) == {("t", 1): ("sent", 2, b"v1")}


@pytest.mark.parametrize("bits", [20, 2])
def test_ids_go_on_over_batches(spark, place, bits):
    root = place("marks")

    def give(batch_id, *rows):
        df = spark.createDataFrame(list(rows), "topic string, arrival bigint")
        return sorted(tuple(r) for r in sends.allocate_ids(df, root, batch_id, "arrival", bits).collect())

    assert give(0, ("a", 5), ("a", 3), ("b", 4)) == [("a", 3, 1), ("a", 5, 2), ("b", 4, 1)]
    assert give(1, ("a", 9)) == [("a", 9, 3)]
    assert give(1, ("a", 9)) == [("a", 9, 3)]
    assert give(2) == []
    # a topic that was not in the batch before goes on as well
    assert give(3, ("b", 10), ("c", 1), ("a", 11), ("b", 12)) == [("a", 11, 4), ("b", 10, 2), ("b", 12, 3), ("c", 1, 1)]
