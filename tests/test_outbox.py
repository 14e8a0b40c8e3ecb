from weirlog.operators import outbox


def queue(spark, *states):
    return spark.createDataFrame(
        [(i, "test", state) for i, state in enumerate(states, 1)], "id bigint, topic string, state string"
    )


def test_ids_continue_after_restart(spark):
    df = spark.createDataFrame([("test", a) for a in (5, 9, 40)], "topic string, arrival bigint")
    first = outbox.enqueue_ids(df, "arrival").orderBy("arrival").collect()
    assert [r.enqueue_id for r in first] == [1, 2, 3]
    later = outbox.enqueue_ids(df, "arrival", last_id=12).orderBy("arrival").collect()
    assert [r.enqueue_id for r in later] == [13, 14, 15]


def test_failed_rows_first_and_never_mixed(spark):
    states = ["sent", "acked"] + ["failed", "failed", "failed"] + ["new"] * 7
    df = queue(spark, *states)
    drained = outbox.drain_order(df, size=2, bits=1).orderBy("topic", "rank", "place").collect()
    assert [r.id for r in drained] == [3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    assert [(r.state, r.batch_no) for r in drained] == [
        ("failed", 0),
        ("failed", 0),
        ("failed", 1),
        ("new", 0),
        ("new", 0),
        ("new", 1),
        ("new", 1),
        ("new", 2),
        ("new", 2),
        ("new", 3),
    ]
    # the last batch of failed rows is short rather than filled with new ones
    assert [r.id for r in outbox.drain_head(df, 5).orderBy("id").collect()] == [3, 4, 5]
    assert [r.id for r in outbox.drain_head(df, 1).collect()] == [3]
    only_new = df.where("state <> 'failed'")
    assert [r.id for r in outbox.drain_head(only_new, 2).orderBy("id").collect()] == [6, 7]
    assert outbox.drain_head(df.where("state = 'acked'"), 2).count() == 0


def test_backlog(spark):
    df = queue(spark, "new", "new", "failed", "acked")
    assert {r.state: r.messages for r in outbox.backlog_depth(df).collect()} == {"new": 2, "failed": 1, "acked": 1}


def test_retry_set_names_the_first_reason(spark):
    df = queue(spark, *["new"] * 6)
    got = outbox.retry_set(
        failed=df.where("id in (1, 2)"), unsent=df.where("id in (2, 3)"), unconfirmed=df.where("id in (1, 3, 4)")
    )
    assert {r.id: r.reason for r in got.collect()} == {1: "failed", 2: "failed", 3: "unsent", 4: "unconfirmed"}
    closed = outbox.retry_set(pending=df, failed=df.where("id = 1"))
    assert closed.count() == 6


def test_slices(spark):
    df = spark.range(1, 2002).selectExpr("id", f"{outbox.slice_of('id', 1000)} as slice")
    sizes = {r.slice: r["count"] for r in df.groupBy("slice").count().collect()}
    assert sizes == {0: 1000, 1: 1000, 2: 1}
