import json
import random

import pytest
from pyspark.sql import functions as F

from weirlog.operators import delivery, envelope, upsert
from weirlog.operators.progress import PARTITION
from weirlog.sources import logs
from weirlog.streaming import documents, sinks, stages
from weirlog.streaming.frontier import current_frontier, held_runs, held_words, track_frontier
from tests.test_envelope import REQ, log


def requests(spark, rows):
    """Log of (id, version, kind) at rising offsets."""
    def text(name, ver, kind):
        msg = {"type": kind, "id": name, "ver": ver, "tsNanos": 1_704_067_200_000_000_000 + int(name) * 40 * 86400 * 10**9}
        return json.dumps({"type": 1, "tsNanos": 1, "msgReq": {**REQ, "id": name, "msg": msg}})

    return log(spark, *[text(*row) if row else "{bad" for row in rows])


class Chain:
    def __init__(self, spark, root, **limits):
        self.spark, self.root = spark, root
        self.accept = stages.accept_stage(sinks.file_topics(f"{root}/accepted"), sinks.table(f"{root}/aside1"), "deliveries")
        self.store = stages.store_stage(
            sinks.file_topics(f"{root}/stored"), sinks.table(f"{root}/aside2"), f"{root}/documents", "changes", "docs", **limits
        )
        self.changes = stages.changes_stage(sinks.table(f"{root}/created"), sinks.table(f"{root}/aside3"))

    def land(self, rows):
        rows.write.mode("append").parquet(f"{self.root}/requests")

    def run(self):
        spark, root = self.spark, self.root
        stages.drain(logs.stream_log(spark, f"{root}/requests", 1), self.accept, f"{root}/at1")
        stages.drain(sinks.stream_topic(spark, f"{root}/accepted", "deliveries"), self.store, f"{root}/at2")
        stages.drain(sinks.stream_topic(spark, f"{root}/stored", "changes"), self.changes, f"{root}/at3")

    def documents(self):
        rows = documents.read_documents(self.spark, f"{self.root}/documents").collect()
        return {r.id: (r.month, r.msg_ver, r.msg_type, r.version) for r in rows}

    def created(self):
        return sorted(r.doc_id.split("_")[1] for r in self.spark.read.parquet(f"{self.root}/created").collect())


FIRST = [("0", 1, 1), ("1", 1, 1), None, ("2", 1, 1), ("0", 1, 1)]
SECOND = [("0", 2, 1), ("1", 1, 1), ("3", 1, 2), ("2", 0, 2)]
DOCUMENTS = {
    "0": ("2024-01", 2, 1, 2),
    "1": ("2024-02", 1, 1, 1),
    "2": ("2024-03", 1, 2, 2),
    "3": ("2024-04", 1, 2, 1),
}


@pytest.mark.parametrize("limits", [{}, {"hot_rows": 1, "slice_rows": 1}])
def test_stages_stop_and_restart(spark, place, limits):
    chain = Chain(spark, place("chain"), **limits)
    later = requests(spark, SECOND).selectExpr(
        "key", "value", "topic", "partition", "offset + 100 as offset", "timestamp_micros(offset + 100) as timestamp"
    )
    chain.land(requests(spark, FIRST).coalesce(1))
    chain.run()
    assert chain.created() == ["0", "1", "2"]
    chain.land(later.coalesce(1))
    chain.run()
    assert chain.documents() == DOCUMENTS
    assert chain.created() == ["0", "1", "2", "3"]
    aside = spark.read.parquet(f"{chain.root}/aside1")
    assert [r.reason for r in aside.collect()] == ["undecodable"]

    # the same rows in one batch
    both = requests(spark, FIRST).unionByName(later)
    accepted = delivery.accept(envelope.good(delivery.requests(both))).withColumnRenamed("event", "data")
    folded = upsert.fold_upserts(
        upsert.document_updates(accepted, "docs"), "doc_id", upsert.LOG_ORDER, upsert.DOCUMENT_FIELDS
    )
    last = {r.id: (r.month, r.msg_ver, r.msg_type, r.version) for r in folded.orderBy("offset").collect()}
    assert last == DOCUMENTS


def test_replayed_batch_is_noop_and_leaves_the_same_tables(spark, place):
    root = place("replay")
    accepted = delivery.accept(envelope.good(delivery.requests(requests(spark, FIRST))))
    topic = sinks.log_rows(accepted, "'deliveries'", "sender", "event")
    store = stages.store_stage(
        sinks.file_topics(f"{root}/stored"), sinks.table(f"{root}/aside"), f"{root}/documents", "changes", "docs"
    )

    def tables():
        return (
            sorted(documents.read_documents(spark, f"{root}/documents").select("id", "version").collect()),
            sinks.read_topic(spark, f"{root}/stored", "changes").count(),
        )

    store(topic, 0)
    before = tables()
    store(topic, 0)  # the batch failed after writing and is run again
    assert tables() == before
    store(topic, 1)  # the rows arrive a second time
    assert tables() == before
    table = documents.documents(f"{root}/documents")
    assert table.batches(spark) == [0, 1]
    # batch 1 has nothing to add
    assert table.segments(spark, 0) == table.segments(spark, 1)
    assert spark.read.parquet(f"{table.root}/segments").count() == 3


def test_frontier_of_a_shuffled_stream(spark, place):
    root = place("frontier")
    key = "topic string, partition int, offset bigint"
    seeds = spark.createDataFrame([("t", 0, 9), ("t", 1, -1), ("t", 2, 4)], "topic string, partition int, frontier bigint")
    batches = [
        [("t", 0, o) for o in (12, 11, 300, 301)] + [("t", 1, 0)],
        [("t", 0, 10), ("t", 0, 12), ("t", 1, 2)],
        [("t", 0, o) for o in range(13, 300)],
    ]
    sink = track_frontier(root, seeds, block=128)
    seen = []
    for batch_id, rows in enumerate(batches):
        for _ in range(2):  # every batch is replayed once
            sink(spark.createDataFrame(rows, key), batch_id)
        seen.append({r.partition: r.frontier for r in current_frontier(spark, root).collect()})
    assert seen == [{0: 9, 1: 0, 2: 4}, {0: 12, 1: 0, 2: 4}, {0: 301, 1: 0, 2: 4}]
    held = held_words(spark, root).collect()
    assert [(r.partition, r.word, r.mask) for r in held] == [(1, 0, 1 << 3)]


def test_a_gap_that_stays_costs_a_batch_what_it_changes(spark, place):
    root = place("frontier-stuck")
    key = "topic string, partition int, offset bigint"
    seeds = spark.createDataFrame([("t", 0, -1)], "topic string, partition int, frontier bigint")
    sink = track_frontier(root, seeds, full_every=4)
    files = spark._jvm.java.io.File
    for batch_id in range(14):  # offset 0 never comes
        sink(spark.createDataFrame([("t", 0, 1 + 100 * batch_id + o) for o in range(100)], key), batch_id)
        changed = spark.read.parquet(f"{root}/changes/batch={batch_id}")
        # one run goes, a longer one comes
        assert changed.where("start is not null").count() == (2 if batch_id else 1)
        assert changed.where("start is null").count() == (0 if batch_id else 1)
    assert [(r.start, r.stop) for r in held_runs(spark, root).collect()] == [(1, 1400)]
    assert len([f for f in files(root.removeprefix("file:") + "/changes").list() if f.startswith("batch=")]) <= 8
    assert len([f for f in files(root.removeprefix("file:") + "/full").list() if f.startswith("batch=")]) == 2
    sink(spark.createDataFrame([("t", 0, 0)], key), 14)
    assert current_frontier(spark, root).first().frontier == 1400 and held_runs(spark, root).isEmpty()


def test_runs_against_brute_force(spark):
    from weirlog.streaming.frontier import advanced, merged_runs, runs_of

    rng = random.Random(11)
    have = {(p, rng.randrange(700)) for p in range(4) for _ in range((p + 1) * 300)}
    known = {p: rng.randrange(-1, 40) for p in range(5)}
    have |= {(2, o) for o in range(known[2] + 1, 420)}
    rows = spark.createDataFrame([("t", p, o) for p, o in have] * 2, "topic string, partition int, offset bigint")
    for block in (64, 100, 1 << 20):
        runs = merged_runs(runs_of(rows), block)
        got = {(r.partition, r.start, r.stop) for r in runs.collect()}
        want = {
            (p, o, next(e for e in range(o, 10**6) if (p, e + 1) not in have or (e + 1) % block == 0))
            for p, o in have if (p, o - 1) not in have or o % block == 0
        }
        assert got == want
        start = spark.createDataFrame([("t", p, f) for p, f in known.items()], "topic string, partition int, frontier bigint")
        reached = {r.partition: r.frontier for r in advanced(runs.join(start, ["topic", "partition"]).where("stop > frontier").drop("frontier"), start, block).collect()}
        assert reached == {p: next(o for o in range(f + 1, 10**6) if (p, o) not in have) - 1 for p, f in known.items()}


def test_frontier_state_with_nothing_held(spark, place):
    root = place("frontier-plain")
    key = "topic string, partition int, offset bigint"
    seeds = spark.createDataFrame([("t", 0, -1)], "topic string, partition int, frontier bigint")
    sink = track_frontier(root, seeds)
    seen = []
    for batch_id, offsets in enumerate(([0, 2], [1], [3], [5], [4])):
        sink(spark.createDataFrame([("t", 0, o) for o in offsets], key), batch_id)
        seen.append(current_frontier(spark, root).first().frontier)
    assert seen == [0, 2, 3, 3, 5]
    sink(spark.createDataFrame([("t", 0, 6)], key), 9)  # batch ids may leave gaps
    assert current_frontier(spark, root).first().frontier == 6


def test_bounded_batches(spark, place):
    root, out = place("bounded"), place("bounded-out")
    log(spark, *["x"] * 40).repartition(8, "offset").write.parquet(root)
    files = spark.read.parquet(root).select(F.input_file_name()).distinct().count()
    sizes = []

    def count(rows, batch_id):
        sizes.append(rows.count())

    stages.drain(logs.stream_log(spark, root, files_per_batch=3), sinks.fan_out(count, sinks.table(out)), place("cp"))
    assert len(sizes) == -(-files // 3) and sum(sizes) == 40
    assert spark.read.parquet(out).count() == 40


def test_a_stream_starts_where_it_is_told(spark, place):
    root, out = place("starts"), place("starts-out")
    log(spark, *["x"] * 10).write.parquet(root)
    resume = spark.createDataFrame([("t", 0, 6)], "topic string, partition int, start bigint")
    stages.drain(logs.from_starts(logs.stream_log(spark, root), resume), sinks.table(out), place("starts-cp"))
    assert {r.offset for r in spark.read.parquet(out).collect()} == {6, 7, 8, 9}


def test_totals_are_reported_by_the_running_query(spark, place):
    from weirlog.operators.metrics import observed_totals

    root = place("observed")
    log(spark, "x", "{bad", "y", None).write.parquet(root)
    stream = observed_totals(
        logs.stream_log(spark, root), "totals", total_in="true", total_err="value is null", total_out="value is not null"
    )
    running = stages.start(stream, sinks.table(place("observed-out")), place("observed-cp"))
    running.awaitTermination()
    seen = [p["observedMetrics"]["totals"].asDict() for p in running.recentProgress if p["numInputRows"] > 0]
    assert seen == [{"total_in": 4, "total_err": 1, "total_out": 3}]


def test_fan_out_gives_each_sink_everything_once(spark, place):
    a, b = place("a"), place("b")
    first, second = sinks.table(a), sinks.table(b)
    with pytest.raises(ValueError):
        sinks.fan_out(first, first)
    both = sinks.fan_out(first, second)
    for _ in range(2):
        both(log(spark, "x", "y"), 3)
    assert spark.read.parquet(a).count() == spark.read.parquet(b).count() == 2


def test_progress_table(spark, place):
    from weirlog.operators.progress import latest_progress

    root = place("progress")
    for batch_id, at in enumerate((5, 9, 9)):
        rows = spark.createDataFrame([("t", 0, at)], "topic string, partition int, frontier bigint")
        sinks.progress(root)(rows, batch_id)
    (row,) = latest_progress(spark.read.parquet(root)).collect()
    assert (row.frontier, row.batch_id) == (9, 2)
    assert set(PARTITION) < set(row.asDict())


def test_bodies_enter_the_chain(spark, place):
    from weirlog.sources.bodies import stream_bodies

    root = place("ingress")
    two = [{**REQ, "id": name, "to": to} for name, to in (("0", REQ["to"]), ("1", []))]
    texts = [json.dumps(two), json.dumps([{**REQ, "id": "2"}]), json.dumps([{"id": 7, "msg": "oops"}])]
    sink = stages.ingress_stage(
        sinks.file_topics(f"{root}/topics"), sinks.table(f"{root}/rsp"), sinks.table(f"{root}/aside"), "requests"
    )

    def land(text):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(f"{root}/bodies")

    for text in texts[:1], texts[1:]:
        for one in text:
            land(one)
        stages.drain(stream_bodies(spark, f"{root}/bodies"), sink, f"{root}/at")
    sent = delivery.requests(sinks.read_topic(spark, f"{root}/topics", "requests")).collect()
    assert {r.data.msgReq.id: r.problem for r in sent} == {"0": None, "1": "no_recipient", "2": None}
    assert all(r.data.tsNanos > 0 for r in sent)
    assert len({(r.partition, r.offset) for r in sent}) == 3
    answers = spark.read.parquet(f"{root}/rsp").collect()
    assert sorted((r.id, r.app, r.errCode, r.errMsg) for r in answers) == [(n, "chat", 0, "") for n in "012"]
    assert [r.reason for r in spark.read.parquet(f"{root}/aside").collect()] == ["bad_element"]


def test_a_crash_between_writes_is_repaired_by_the_restart(spark, place):
    root = place("crash")
    chain = Chain(spark, root)
    failures = [RuntimeError("lost after the documents were written")]
    topics = sinks.file_topics(f"{root}/stored")

    def flaky(rows, batch_id):
        if failures:
            raise failures.pop()
        topics(rows, batch_id)

    chain.store = stages.store_stage(flaky, sinks.table(f"{root}/aside2"), f"{root}/documents", "changes", "docs")
    chain.land(requests(spark, FIRST).coalesce(1))
    with pytest.raises(Exception, match="lost after"):
        chain.run()
    assert len(chain.documents()) == 3
    chain.run()
    assert {k: v[-1] for k, v in chain.documents().items()} == {"0": 1, "1": 1, "2": 1}
    assert chain.created() == ["0", "1", "2"]


def test_progress_beside_a_stage_gives_resume_positions(spark, place):
    from weirlog.operators.progress import partition_ranges, resume_offsets

    root = place("beside")
    chain = Chain(spark, root)
    seeds = spark.createDataFrame([("t", 0, -1)], "topic string, partition int, frontier bigint")
    both = sinks.fan_out(chain.accept, track_frontier(f"{root}/progress", seeds))
    chain.land(requests(spark, FIRST).coalesce(1))
    stages.drain(logs.stream_log(spark, f"{root}/requests"), both, f"{root}/at")
    saved = current_frontier(spark, f"{root}/progress").withColumnRenamed("frontier", "saved")
    ranges = partition_ranges(logs.read_log(spark, f"{root}/requests"))
    (row,) = resume_offsets(ranges, saved).collect()
    # the undecodable row is confirmed like the others
    assert (row.saved, row.first_offset, row.start) == (4, 5, -1)
    more = ranges.selectExpr("topic", "partition", "oldest", "newest + 3 as newest")
    assert resume_offsets(more, saved).first().start == 5


def test_a_new_checkpoint_over_stored_documents_is_refused(spark, place):
    chain = Chain(spark, place("owner"))
    chain.land(requests(spark, FIRST).coalesce(1))
    chain.run()
    before = chain.documents()
    stream = sinks.stream_topic(spark, f"{chain.root}/accepted", "deliveries")
    with pytest.raises(Exception, match="belongs to stream"):
        stages.drain(stream, chain.store, f"{chain.root}/at-another-place")
    assert chain.documents() == before
    # the stream itself goes on
    chain.land(requests(spark, SECOND).selectExpr("key", "value", "topic", "partition", "offset + 100 as offset", "timestamp_micros(offset + 100) as timestamp").coalesce(1))
    chain.run()
    assert chain.documents() == DOCUMENTS


def test_completed_batches_are_left_alone(spark, place):
    root = place("once")
    sinks.table(root)(spark.range(3), 0)
    files = sorted(spark.read.parquet(root).inputFiles())
    sinks.table(root)(spark.range(5), 0)
    assert sorted(spark.read.parquet(root).inputFiles()) == files
    assert spark.read.parquet(root).count() == 3


def test_documents_never_stored(spark, place):
    assert documents.read_documents(spark, place("nothing")).count() == 0
