"""The registered queries: name -> (session, table folder) -> DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog.functions import codes, identity, times, unions
from weirlog.operators import delivery, envelope, metrics, outbox, progress, routing, upsert
from weirlog.operators.progress import PARTITION
from weirlog.plans import views
from weirlog.schemas import REQUEST_MSG_REQ, STORE_EVENT, STORE_MSG_CREATED
from weirlog.session import scratch, settle
from weirlog.sources import bodies, logs
from weirlog.streaming import documents, keyed_topics, sends, sinks, stages
from weirlog.streaming.frontier import current_frontier, held_runs, track_frontier
from weirlog.streaming.matching import match_answers, once

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

INDEX = "docs"
PLACE = ("topic", "partition as part", "offset as off")


DOCUMENT_COLUMNS = (
    "doc_id",
    "month",
    "msg_type",
    "msg_ver",
    "from_user",
    "size(to) as to_count",
    "md5(get(session_data, 0).value.data) as text_md5",
    "version",
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _text_md5(session: str) -> str:
    return f"md5(get({session}.data, 0).value.data) as text_md5"


def _request_columns(req: str) -> list[str]:
    return [
        f"{req}.id as id",
        f"{req}.app as app",
        f"{req}.session.type as session_type",
        f"{req}.msg.type as msg_type",
        f"{req}.msg.ver as ver",
        f"{req}.msg.tsNanos as ts_nanos",
        f"{req}.`from`.user.type as from_user",
        f"{req}.`from`.channel.type as from_channel",
        f"size({req}.to) as to_count",
        _text_md5(f"{req}.session"),
    ]


# --- sources --------------------------------------------------------------------------------


@query
def log_scan(spark, sf):
    root = scratch(spark, "log")
    views.raw_log(views.event_log(spark, sf)).write.parquet(root)
    log = logs.read_log(spark, root)
    saved = settle(views.saved_offsets(log))
    resume = progress.resume_offsets(progress.partition_ranges(log), saved)
    return logs.from_starts(log, resume).selectExpr(
        *PLACE, "decode(key, 'UTF-8') as log_key", "decode(value, 'UTF-8') as log_value", "unix_micros(timestamp) as ts_us"
    )


@query
def partition_ranges(spark, sf):
    return progress.partition_ranges(views.event_log(spark, sf)).selectExpr(
        "topic", "partition as part", "oldest", "newest"
    )


@query
def resume_offsets(spark, sf):
    log = settle(views.event_log(spark, sf))
    resume = progress.resume_offsets(progress.partition_ranges(log), views.saved_offsets(log))
    return resume.selectExpr(
        "topic", "partition as part", "oldest", "newest", "saved", "first_offset", "start as start_at"
    )


def _resume_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every case of resuming: unsaved, saved at 0, rows lost by trimming, all done, and an empty partition."""
    log = settle(views.event_log(spark, sf).where("not (partition = 2 and offset < 150)"))
    empty = spark.createDataFrame([("events", views.PARTITIONS, 0, 0)], "topic string, partition int, oldest bigint, newest bigint")
    ranges = progress.partition_ranges(log).unionByName(empty)
    return progress.resume_offsets(ranges, views.saved_offsets(log))


@query
def resume_cases(spark, sf):
    return _resume_cases(spark, sf).selectExpr(
        "topic",
        "partition as part",
        "oldest",
        "newest",
        "saved",
        "coalesce(first_offset, -9L) as first_offset",
        "coalesce(start, -9L) as start_at",
        "coalesce(problem, '') as problem",
    )


@query
def starting_offsets(spark, sf):
    """Start positions as a Kafka source takes them, of the partitions that can be resumed."""
    return progress.starting_offsets(_resume_cases(spark, sf).where("problem is null"))


@query
def json_requests(spark, sf):
    parsed = bodies.parse_bodies(views.bodies(spark, sf))
    return bodies.requests_of(parsed).selectExpr("body_id", "place", *_request_columns("req"))


# --- sinks ----------------------------------------------------------------------------------


@query
def keyed_sink(spark, sf):
    root = scratch(spark, "keyed-sink")
    sinks.file_topics(root)(views.raw_log(views.event_log(spark, sf), "concat('out-', event_type)"), 0)
    return sinks.read_topic(spark, root).selectExpr(
        *PLACE, "decode(key, 'UTF-8') as log_key", "decode(value, 'UTF-8') as log_value"
    )


@query
def upsert_snapshot(spark, sf):
    root = scratch(spark, "documents")
    for batch_id, log in enumerate((views.first_requests(spark, sf), views.repeated_requests(spark, sf))):
        updates = upsert.document_updates(_accepted(log), INDEX).persist()
        documents.store_documents(documents.fold_batch(updates, root, batch_id), root, batch_id)
        updates.unpersist()
    return documents.read_documents(spark, root).selectExpr(*DOCUMENT_COLUMNS)


#: Batches of the levelled table's query: a first delivery of every document, then a second one.
LEVELLED = 20


@query
def levelled_store(spark, sf):
    """Deliveries in twenty batches, the last of them run twice; segments are merged on the way."""
    root = scratch(spark, "levelled")
    parts = [
        upsert.document_updates(_accepted(log), INDEX).selectExpr("*", f"pmod(xxhash64(doc_id), {LEVELLED // 2}) + {first} as batch_id")
        for first, log in ((0, views.first_requests(spark, sf)), (LEVELLED // 2, views.repeated_requests(spark, sf)))
    ]
    updates = settle(parts[0].unionByName(parts[1]))
    for batch_id in (*range(LEVELLED), LEVELLED - 1):
        batch = updates.where(f"batch_id = {batch_id}").drop("batch_id")
        documents.store_documents(documents.fold_batch(batch, root, batch_id), root, batch_id)
    return documents.read_documents(spark, root).selectExpr(*DOCUMENT_COLUMNS)


@query
def progress_latest(spark, sf):
    """The frontiers of four batches through the progress sink, the first of them delivered twice."""
    root = scratch(spark, "progress")
    log = settle(views.event_log(spark, sf).selectExpr(*PARTITION, "offset", "least(3, offset div 1000) as batch_id"))
    for batch_id in (0, 0, 1, 2, 3):
        rows = log.where(f"batch_id = {batch_id}").groupBy(*PARTITION).agg(F.expr("max(offset) as frontier"))
        sinks.progress(root)(rows, batch_id)
    saved = sinks.read_progress(spark, root)
    return progress.latest_progress(saved).selectExpr("topic", "partition as part", "frontier", "batch_id")


@query
def fan_out(spark, sf):
    roots = {name: scratch(spark, f"fan-out-{name}") for name in ("left", "right")}
    both = sinks.fan_out(*[sinks.table(root) for root in roots.values()])
    stages.drain(_event_stream(spark, sf), both, scratch(spark, "fan-out"))
    left, right = [
        spark.read.schema(sinks.LOG).parquet(root).selectExpr(f"'{name}' as sink", *PLACE)
        for name, root in roots.items()
    ]
    return left.unionByName(right)


# --- projections ----------------------------------------------------------------------------


def _decoded_requests(spark: SparkSession, sf: str) -> DataFrame:
    log = views.request_log(spark, sf)
    return envelope.good(envelope.decode(log, delivery.REQUEST, delivery.REQUEST_WIDE, delivery.REQUEST_NANOS))


@query
def decode_envelope(spark, sf):
    return _decoded_requests(spark, sf).selectExpr(
        *PLACE, "data.type as type", "data.tsNanos as envelope_nanos", *_request_columns("data.msgReq")
    )


@query
def quarantine(spark, sf):
    events = envelope.decode(views.damaged_log(spark, sf), views.PROPS)
    requests = delivery.requests(views.request_log(spark, sf))
    bad = envelope.quarantine(events).unionByName(envelope.quarantine(requests))
    return bad.selectExpr(*PLACE, "key_hex", "value_hex", "reason")


@query
def wrap_request(spark, sf):
    rows = views.messages(spark, sf).selectExpr(f"{delivery.wrap_request('req', 'ts_nanos + 1000000')} as request")
    return rows.selectExpr(
        "request.type as type", "request.tsNanos as envelope_nanos", *_request_columns("request.msgReq")
    )


@query
def send_response(spark, sf):
    return views.messages(spark, sf).selectExpr(f"{delivery.response('req')} as rsp").selectExpr(
        "rsp.id as id",
        "rsp.app as app",
        "rsp.session.type as session_type",
        _text_md5("rsp.session"),
        "rsp.errCode as err_code",
        "rsp.errMsg as err_msg",
    )


@query
def sender_key(spark, sf):
    return views.messages(spark, sf).selectExpr("req.id as id", f"{identity.sender_key('req.`from`')} as sender")


@query
def accept_delivery(spark, sf):
    rows = delivery.requests(views.request_log(spark, sf))
    return delivery.accept(envelope.good(rows)).selectExpr(
        *PLACE,
        "sender",
        "event.type as type",
        "event.tsNanos as event_nanos",
        "event.msgDelivery.req.id as id",
        "size(event.msgDelivery.report) as reports",
        "get(event.msgDelivery.report, 0).`from`.user.type as from_user",
        "get(event.msgDelivery.report, 0).to.user.type as to_user",
        "get(event.msgDelivery.report, 0).stat.code as code",
    )


@query
def doc_id(spark, sf):
    return views.messages(spark, sf).selectExpr("conv_id", "turn", f"{identity.document_id('req')} as doc_id")


@query
def month_index(spark, sf):
    turns = views.messages(spark, sf).selectExpr("req.id as id", "ts_nanos")
    orders = views.source(spark, sf, "orders").selectExpr(
        "cast(o_orderkey as string) as id", f"{times.micros_of('o_orderdate')} * 1000 as ts_nanos"
    )
    return turns.unionByName(orders).selectExpr("id", f"{identity.month_index('ts_nanos', INDEX)} as month_index")


@query
def doc_body(spark, sf):
    return views.messages(spark, sf).selectExpr("conv_id", "turn", f"{identity.document_body('req')} as body")


def _folded_requests(spark: SparkSession, sf: str) -> DataFrame:
    # decoded once: the fold reads its input twice
    updates = settle(upsert.document_updates(_accepted(views.request_log(spark, sf)), INDEX))
    return upsert.fold_upserts(updates, "doc_id", upsert.LOG_ORDER, upsert.DOCUMENT_FIELDS)


@query
def created_events(spark, sf):
    return upsert.created_events(_folded_requests(spark, sf)).selectExpr(
        "sender",
        "event.type as type",
        "event.tsNanos as event_nanos",
        "event.msgCreated.index as doc_index",
        "event.msgCreated.id as doc_id",
        "event.msgCreated.type as doc_type",
        "event.msgCreated.ver as ver",
    )


@query
def tag_union(spark, sf):
    sides = " ".join(f"when {code} then {unions.tagged(code)}" for code in (32, 33, 64, 65))
    side = f"case req.`from`.user.type {sides} end"
    made = views.messages(spark, sf).selectExpr(
        "req.id as id",
        f"{side} as user",
        f"{side} as channel",
        f"{delivery.wrap_request('req', 'ts_nanos')} as request",
        f"{delivery.accepted_event('req')} as event",
        f"{upsert.created_event(repr(INDEX), 'req.id', 'req.msg.ver')} as created",
        f"{unions.tagged(33)} as updated",
        f"{unions.tagged(34)} as deleted",
    )
    return made.selectExpr(
        "id",
        "user.type as user_tag",
        "channel.type as channel_tag",
        "request.type as request_tag",
        "request.msgReq.msg.ver as request_ver",
        "event.type as event_tag",
        "event.msgDelivery.req.id as event_req",
        "created.type as created_tag",
        "created.msgCreated.id as created_id",
        "updated.type as updated_tag",
        "deleted.type as deleted_tag",
    )


@query
def union_check(spark, sf):
    problem = unions.union_problem("type", {REQUEST_MSG_REQ: "req"})
    return views.tagged_requests(spark, sf).selectExpr("id", "type", f"coalesce({problem}, 'valid') as verdict")


@query
def enum_names(spark, sf):
    kind = "req.msg.type"
    pairs = {
        "data_format": "get(req.session.data, 0).value.format",
        "session_type": "req.session.type",
        "channel_type": "req.`from`.channel.type",
        "user_type": "req.`from`.user.type",
        "role_type": f"if({kind} <= 2, {kind}, 0)",
        "msg_type": kind,
        "request_type": "if(turn % 5 = 4, 0, 1)",
        "event_type": "if(turn % 5 = 4, 0, 10)",
        "store_event_type": f"case {kind} when 2 then 32 when 1 then 33 else 34 end",
    }
    used = ", ".join(f"named_struct('enum', '{enum}', 'code', {code})" for enum, code in pairs.items())
    codes_used = views.messages(spark, sf).selectExpr(f"inline(array({used}))")
    codes_sent = views.source(spark, sf, "events").selectExpr(
        "'delivery_code' as enum", f"{views.DELIVERY_CODE} as code"
    )
    counts = codes_used.unionByName(codes_sent).groupBy("enum", "code").agg(F.expr("count(1) as uses"))
    return counts.selectExpr("*", f"{codes.enum_name('enum', 'code')} as name")


@query
def event_time(spark, sf):
    rows = views.source(spark, sf, "events").selectExpr(
        "event_id", f"{times.micros_of('ts')} * 1000 + event_id % 1000 as ts_nanos"
    )
    at = times.event_time("ts_nanos")
    return rows.selectExpr(
        "event_id",
        f"unix_micros({at}) as event_us",
        f"date_format({at}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') as event_time",
        "ts_nanos % 1000 as rest_nanos",
    )


@query
def route_mod(spark, sf):
    return routing.route(views.event_log(spark, sf), 3).selectExpr(*PLACE, "subscriber")


@query
def transform_chain(spark, sf):
    rows = routing.chain(
        views.event_log(spark, sf),
        views.raw_log,
        lambda log: envelope.decode(log, views.PROPS),
        envelope.good,
    )
    return rows.selectExpr(*PLACE, "decode(key, 'UTF-8') as log_key", "decode(value, 'UTF-8') as log_value")


# --- filters --------------------------------------------------------------------------------


@query
def filter_request_type(spark, sf):
    rows = envelope.of_type(_decoded_requests(spark, sf), REQUEST_MSG_REQ)
    return rows.selectExpr(*PLACE, "data.msgReq.id as id")


@query
def filter_event_type(spark, sf):
    rows = delivery.delivery_events(views.delivery_log(spark, sf))
    return rows.selectExpr(*PLACE, "coalesce(problem, 'upsert') as action")


@query
def filter_created(spark, sf):
    return stages.created_documents(views.change_log(spark, sf)).selectExpr(
        "partition as part", "offset as off", "index as doc_index", "doc_id", "version"
    )


def _user_documents(spark: SparkSession, sf: str) -> DataFrame:
    return upsert.fold_upserts(views.document_log(spark, sf), "user_id", ["event_id"], ["f_status", "f_tier"])


@query
def outcome_action(spark, sf):
    status = f"case when {views.IS_ERROR} then 429 when outcome = 'created' then 201 else 200 end"
    rows = _user_documents(spark, sf).selectExpr("user_id", "event_id", "outcome", f"{status} as status")
    return rows.selectExpr("*", f"{upsert.outcome_action('status', 'outcome')} as action")


@query
def delivery_class(spark, sf):
    rows = views.source(spark, sf, "events").selectExpr("event_id", f"{views.DELIVERY_CODE} as code")
    return rows.selectExpr(
        "*", f"{codes.delivery_class('code')} as class", f"{codes.retryable('code')} as retryable"
    )


# --- joins ----------------------------------------------------------------------------------


@query
def correlate_outcome(spark, sf):
    log = settle(views.event_log(spark, sf))
    responses = log.where("event_type <> 'signup'").selectExpr(
        *PARTITION, "offset", f"if({views.IS_ERROR}, 429, 200) as status"
    )
    pairs = upsert.correlate(log.select(*PARTITION, "offset", "event_id"), responses)
    return pairs.selectExpr(*PLACE, "event_id", "status")


@query
def upsert_lookup(spark, sf):
    """Documents of a second delivery looked up in the table that the first one left."""
    root = scratch(spark, "looked-up")
    first = settle(upsert.document_updates(_accepted(views.first_requests(spark, sf)), INDEX))
    documents.store_documents(documents.fold_batch(first, root, 0), root, 0)
    batch = settle(upsert.document_updates(_accepted(views.repeated_requests(spark, sf)), INDEX).select("doc_id", "month"))
    return upsert.lookup_existing(batch.select("doc_id"), documents.document_versions(batch, root)).selectExpr(
        "doc_id", "coalesce(stored_version, 0) as stored_version", "stored_version is not null as found"
    )


@query
def unconfirmed(spark, sf):
    sends = views.outbox(spark, sf)
    return outbox.unconfirmed(sends, sends.where(views.IS_ACK).select("id")).select("id", "topic", "event_type")


@query
def failed_sends(spark, sf):
    sends = views.outbox(spark, sf)
    return outbox.failed_sends(sends, sends.where(views.IS_ERROR).select("id")).select("id", "topic", "event_type")


# --- aggregations ---------------------------------------------------------------------------


def _confirmed(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    return envelope.confirmed(log.where(f"not {views.IS_ERROR}")), views.saved_offsets(log, "frontier")


@query
def frontier(spark, sf):
    return progress.frontier(*_confirmed(settle(views.event_log(spark, sf)))).selectExpr(
        "topic", "partition as part", "frontier"
    )


@query
def held_offsets(spark, sf):
    return progress.held_offsets(*_confirmed(settle(views.event_log(spark, sf)))).selectExpr(*PLACE, "frontier")


@query
def sink_totals(spark, sf):
    return metrics.sink_totals(
        views.outbox(spark, sf),
        total_in="true",
        total_out=views.IS_ACK,
        total_err=views.IS_ERROR,
        total_get="state <> 'new'",
    )


@query
def backlog_depth(spark, sf):
    return outbox.backlog_depth(views.outbox(spark, sf))


@query
def latency_stats(spark, sf):
    rows = views.event_log(spark, sf).selectExpr("*", "ts_us - cast(round(amount * 1000) as bigint) as sent_us")
    return metrics.latency_stats(rows, "sent_us", "ts_us").selectExpr(
        "topic", "partition as part", "messages", "total_latency", "mean_latency"
    )


@query
def throughput_checkpoints(spark, sf):
    return metrics.throughput_checkpoints(views.arrivals(spark, sf), "event_id", "ts_us")


# --- windows, order, sets -------------------------------------------------------------------


@query
def pending_gate(spark, sf):
    rows = views.event_log(spark, sf).selectExpr(
        "*", "cast(if(event_type in ('click', 'view'), 3, -4) as bigint) as delta"
    )
    return metrics.pending_gate(rows, PARTITION, "offset", "delta", 5).selectExpr(*PLACE, "delta", "pending", "ready")


@query
def upsert_outcome(spark, sf):
    return _user_documents(spark, sf).selectExpr(
        "user_id",
        "event_id",
        "coalesce(f_status, '') as f_status",
        "coalesce(f_tier, -1) as f_tier",
        "outcome",
        "version",
    )


@query
def enqueue_id(spark, sf):
    return outbox.enqueue_ids(views.arrivals(spark, sf), "event_id").select("event_id", "topic", "enqueue_id")


@query
def batch_slices(spark, sf):
    return outbox.enqueue_ids(views.arrivals(spark, sf), "event_id").selectExpr(
        "event_id",
        f"{outbox.slice_of('enqueue_id', outbox.SAVE_SLICE)} as save_slice",
        f"{outbox.slice_of('enqueue_id', outbox.SEND_BATCH)} as send_batch",
    )


@query
def frontier_changes(spark, sf):
    """Frontiers after each of four batches; only those that moved are reported."""
    log = settle(views.event_log(spark, sf).selectExpr("*", "least(3, offset div 1000) as batch_id"))
    seeds = settle(views.saved_offsets(log, "frontier"))
    confirmed = log.where(f"not {views.IS_ERROR}")
    moved = progress.frontier_history(confirmed, seeds, "batch_id").selectExpr(*PARTITION, "frontier", "batch as offset")
    # the first batch is reported whether it moved anything or not
    begun = seeds.select(*PARTITION, "frontier").unionByName(confirmed.selectExpr(*PARTITION, "-1L as frontier").distinct())
    first = begun.selectExpr(*PARTITION, "frontier", "0L as offset")
    merged = moved.unionByName(first).groupBy(*PARTITION, "offset").agg(F.max("frontier").alias("frontier"))
    return progress.frontier_changes(merged, "offset").selectExpr(*PLACE, "frontier")


@query
def drain_order(spark, sf):
    return outbox.drain_order(views.outbox(spark, sf)).select("id", "topic", "state", "rank", "place", "batch_no")


@query
def drain_head(spark, sf):
    return outbox.drain_head(views.outbox(spark, sf), outbox.SEND_BATCH).select("id", "topic", "state", "place")


@query
def retry_set(spark, sf):
    sends = views.outbox(spark, sf)
    plan = outbox.retry_plan(sends, sends.where(views.IS_ACK).select("id"), sends.where(views.IS_ERROR).select("id"))
    return plan.select("id", "topic", "reason")


@query
def enqueue_batches(spark, sf):
    """Ids over three batches, the second of them run twice."""
    root = scratch(spark, "marks")
    rows = views.source(spark, sf, "events").selectExpr("event_id", "event_type as topic", "least(2, event_id div 300) as batch_id")
    given = {}
    for batch_id in (0, 1, 1, 2):
        batch = rows.where(f"batch_id = {batch_id}").drop("batch_id")
        given[batch_id] = sends.allocate_ids(batch, root, batch_id, "event_id")
    return functools.reduce(DataFrame.unionByName, given.values()).select("event_id", "topic", "enqueue_id")


@query
def send_state(spark, sf):
    """The queue after four batches of changes, the third of them run twice, with a restart before the last."""
    root = scratch(spark, "sends")
    history = settle(views.send_history(spark, sf))
    changes = [history.where(f"batch_id = {n}").drop("batch_id") for n in range(4)]
    for batch_id in (0, 1, 2, 2):
        sends.apply_changes(changes[batch_id], root, batch_id)
    sends.restore(spark, root, 3)
    sends.apply_changes(changes[3], root, 4)
    left = sends.send_table(root).read(spark)
    queued = outbox.drain_order(left.selectExpr("topic", "id", "state", "sends", "md5(value) as value_md5"))
    return queued.select("topic", "id", "state", "sends", "value_md5", "rank", "place", "batch_no")


@query
def replay_noop(spark, sf):
    """Every request twice, as two batches of the document table; each batch is run twice, too."""
    root = scratch(spark, "replayed")
    updates = settle(upsert.document_updates(_accepted(views.repeated_requests(spark, sf)), INDEX))
    passes = []
    for batch_id in (0, 1):
        for _ in ("first attempt", "replay"):
            folded = settle(documents.fold_batch(updates, root, batch_id))
            documents.store_documents(folded, root, batch_id)
        passes.append(folded.selectExpr("doc_id", f"{batch_id + 1} as pass_no", "outcome", "version"))
    return passes[0].unionByName(passes[1])


@query
def remaining_after_failure(spark, sf):
    rows = views.event_log(spark, sf).selectExpr("*", f"{outbox.slice_of('(offset + 1)', 100)} as slice_no")
    failed = "event_type = 'error' and amount > 200"
    left = outbox.remaining_after_failure(rows, PARTITION, "offset", "slice_no", failed)
    return left.selectExpr(*PLACE, "slice_no", "first_failed")


# --- streams --------------------------------------------------------------------------------


# Bounds of a micro-batch, whatever the size of the tables.
ROWS_PER_FILE = 1_000_000
FILES_PER_BATCH = 1_000


def _event_stream(spark: SparkSession, sf: str, keep: str = "true") -> DataFrame:
    """The event log written out by offset and read back as a stream, a few files at a time."""
    root, tasks = scratch(spark, "event-log"), max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = views.raw_log(views.event_log(spark, sf).where(keep)).repartition(tasks, *PARTITION, "offset")
    rows.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(root)
    return logs.stream_log(spark, root, files_per_batch=min(-(-tasks // 4), FILES_PER_BATCH))


def _accepted(log: DataFrame) -> DataFrame:
    """Accepted deliveries of a request log, as the store stage would decode them."""
    return delivery.accept(envelope.good(delivery.requests(log))).withColumnRenamed("event", "data")


@query
def stream_bounded(spark, sf):
    root = scratch(spark, "bounded")
    stages.drain(_event_stream(spark, sf), sinks.table(root), scratch(spark, "bounded-progress"))
    return spark.read.schema(sinks.LOG).parquet(root).selectExpr(*PLACE, "decode(value, 'UTF-8') as log_value")


@query
def stage_ingress(spark, sf):
    root = scratch(spark, "ingress")
    views.bodies(spark, sf).select("value").write.text(f"{root}/bodies")
    sink = stages.ingress_stage(
        sinks.file_topics(f"{root}/topics"), sinks.table(f"{root}/responses"), sinks.table(f"{root}/aside"), "requests"
    )
    stages.drain(bodies.stream_bodies(spark, f"{root}/bodies", False, FILES_PER_BATCH), sink, f"{root}/progress")
    sent = envelope.good(delivery.requests(sinks.read_topic(spark, f"{root}/topics", "requests")))
    answered = spark.read.parquet(f"{root}/responses").selectExpr("id", "errCode as err_code")
    sent = sent.selectExpr(
        "decode(key, 'UTF-8') as sender", "data.type as type", *_request_columns("data.msgReq")
    )
    return sent.join(answered, "id")


class _Store:
    """Folders of one run of the chained stages over the request log."""

    def __init__(self, spark: SparkSession, sf: str, land: bool = True):
        self.spark = spark
        self.root = scratch(spark, "store")
        self.documents = f"{self.root}/documents"
        # two appends, so that second deliveries come after first ones
        for log in (views.first_requests(spark, sf), views.repeated_requests(spark, sf)) if land else ():
            self.land(log)

    def land(self, log: DataFrame) -> None:
        log.write.mode("append").parquet(f"{self.root}/requests")

    def _aside(self, stage: str) -> sinks.Sink:
        return sinks.table(f"{self.root}/aside-{stage}")

    def accept(self) -> DataFrame:
        sink = stages.accept_stage(sinks.file_topics(f"{self.root}/accepted"), self._aside("accept"), "deliveries")
        stream = logs.stream_log(self.spark, f"{self.root}/requests", FILES_PER_BATCH)
        stages.drain(stream, sink, f"{self.root}/at-accept")
        return sinks.read_topic(self.spark, f"{self.root}/accepted", "deliveries")

    def store(self) -> DataFrame:
        self.accept()
        sink = stages.store_stage(
            sinks.file_topics(f"{self.root}/stored"), self._aside("store"), self.documents, "changes", INDEX
        )
        stream = sinks.stream_topic(self.spark, f"{self.root}/accepted", "deliveries", FILES_PER_BATCH)
        stages.drain(stream, sink, f"{self.root}/at-store")
        return sinks.read_topic(self.spark, f"{self.root}/stored", "changes")

    def changes(self) -> DataFrame:
        self.store()
        sink = stages.changes_stage(sinks.table(f"{self.root}/created"), self._aside("changes"))
        stream = sinks.stream_topic(self.spark, f"{self.root}/stored", "changes", FILES_PER_BATCH)
        stages.drain(stream, sink, f"{self.root}/at-changes")
        return self.spark.read.parquet(f"{self.root}/created")


@query
def stage_accept(spark, sf):
    return envelope.good(delivery.delivery_events(_Store(spark, sf).accept())).selectExpr(
        *PLACE,
        "decode(key, 'UTF-8') as sender",
        f"{identity.document_id('data.msgDelivery.req')} as doc_id",
        "get(data.msgDelivery.report, 0).stat.code as code",
    )


TARGETS = 3


def _keyed_accept(spark: SparkSession, sf: str) -> tuple[str, str]:
    """The accept stage over two landings, bad rows among them, into a keyed topic; (its root, that of the frontiers saved)."""
    store = _Store(spark, sf, land=False)
    root, saved = f"{store.root}/keyed", f"{store.root}/saved"
    seeds = spark.createDataFrame([], "topic string, partition int, frontier bigint")
    sink = stages.accept_stage(keyed_topics.keyed_topics(root, TARGETS), store._aside("accept"), "deliveries")
    sink = stages.with_progress(sink, saved, seeds)
    for log in (views.first_requests(spark, sf), views.repeated_requests(spark, sf)):
        store.land(log)
        stages.drain(logs.stream_log(spark, f"{store.root}/requests", FILES_PER_BATCH), sink, f"{store.root}/at-accept")
    return root, saved


@query
def keyed_accept(spark, sf):
    rows = envelope.good(delivery.delivery_events(keyed_topics.read_keyed(spark, _keyed_accept(spark, sf)[0], "deliveries")))
    return rows.selectExpr(*PLACE, "decode(key, 'UTF-8') as sender", f"{identity.document_id('data.msgDelivery.req')} as doc_id")


@query
def saved_progress(spark, sf):
    """Frontiers that the accept stage has saved, and those of the topic it wrote, which has no gaps."""
    root, saved = _keyed_accept(spark, sf)
    written = keyed_topics.read_keyed(spark, root).select(*PARTITION, "offset")
    seeds = written.select(*PARTITION).distinct().selectExpr(*PARTITION, "-1L as frontier")
    both = current_frontier(spark, saved).unionByName(progress.frontier(written, seeds))
    return both.selectExpr("topic", "partition as part", "frontier")


@query
def stage_store(spark, sf):
    rows = envelope.good(envelope.decode(_Store(spark, sf).store(), STORE_EVENT))
    return envelope.of_type(rows, STORE_MSG_CREATED).selectExpr(
        "partition as part",
        "offset as off",
        "decode(key, 'UTF-8') as sender",
        "data.msgCreated.index as doc_index",
        "data.msgCreated.id as doc_id",
        "data.msgCreated.ver as version",
    )


@query
def store_restart(spark, sf):
    """The stages over first deliveries, stopped, and started again over second ones."""
    store = _Store(spark, sf, land=False)
    for log in (views.first_requests(spark, sf), views.repeated_requests(spark, sf)):
        store.land(log)
        store.store()
    return documents.read_documents(spark, store.documents).selectExpr(*DOCUMENT_COLUMNS)


@query
def stage_changes(spark, sf):
    return _Store(spark, sf).changes().selectExpr(
        "partition as part", "offset as off", "index as doc_index", "doc_id", "version"
    )


@query
def frontier_stream(spark, sf):
    seeds = settle(views.saved_offsets(views.event_log(spark, sf), "frontier"))
    root = scratch(spark, "frontier")
    stream = _event_stream(spark, sf, f"not {views.IS_ERROR}").select(*PARTITION, "offset")
    stages.drain(stream, track_frontier(root, seeds), scratch(spark, "frontier-progress"))
    return current_frontier(spark, root).selectExpr("topic", "partition as part", "frontier")


@query
def held_stream(spark, sf):
    """Runs of offsets held back at the end of a stream that confirms later offsets first."""
    log = settle(views.event_log(spark, sf))
    seeds = settle(views.saved_offsets(log, "frontier"))
    root = scratch(spark, "held")
    sink = track_frontier(root, seeds, full_every=2)
    for batch_id, part in enumerate(("offset >= 2000", "offset < 1000", "offset between 1000 and 1999")):
        sink(envelope.confirmed(log.where(f"not {views.IS_ERROR} and {part}")), batch_id)
    return held_runs(spark, root).selectExpr("topic", "partition as part", "start as first_off", "stop as last_off")


#: Landings of the streams that are matched, by time; a row of a far later time follows, so that all earlier ones are due.
LANDINGS = 3
CLOSING = "timestamp'2100-01-01'"


def _landings(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Events as (id, at, event_type, amount, landing), by landing."""
    rows = views.source(spark, sf, "events").selectExpr(
        "event_id as id", "cast(ts as timestamp) as at", "event_type", "value as amount", f"cast(least({LANDINGS - 1}, (dayofmonth(ts) - 1) div 10) as int) as landing"
    )
    rows = settle(rows)
    return [rows.where(f"landing = {n}").drop("landing") for n in range(LANDINGS)]


def _landed(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """A stream of what is landed in a folder."""
    spark.createDataFrame([], schema).write.parquet(root)
    return spark.readStream.schema(schema).parquet(root)


def _closing(spark: SparkSession, name: str) -> DataFrame:
    return spark.range(-1, 0).selectExpr("id", f"{CLOSING} as {name}")


@query
def answered_stream(spark, sf):
    """Sends and answers as streams; errors are never answered, and every seventh answer comes too late."""
    root = scratch(spark, "answered")
    schemas = {"sends": "id bigint, sent_at timestamp", "answers": "id bigint, answered_at timestamp"}
    streams = {name: _landed(spark, f"{root}/{name}", schema) for name, schema in schemas.items()}
    matched = match_answers(streams["sends"], streams["answers"], ["id"], within="5 minutes", lateness="10 minutes")
    late = "answered_at"
    for rows in [*_landings(spark, sf), None]:
        sent = _closing(spark, "sent_at") if rows is None else rows.selectExpr("id", "at as sent_at")
        back = _closing(spark, late) if rows is None else rows.where(views.IS_ACK).selectExpr("id", f"at + make_interval(0, 0, 0, 0, 0, id % 7) as {late}")
        sent.write.mode("append").parquet(f"{root}/sends")
        back.write.mode("append").parquet(f"{root}/answers")
        stages.drain(matched, sinks.table(f"{root}/matched"), f"{root}/progress")
    found = spark.read.schema("id bigint, sent_at timestamp, answered_at timestamp").parquet(f"{root}/matched").where("id >= 0")
    return found.selectExpr("id", "answered_at is not null as answered", "coalesce(unix_micros(answered_at) - unix_micros(sent_at), -1) as waited_us")


@query
def suppressed_repeats(spark, sf):
    """Events delivered up to three times over three batches, each kept once."""
    root = scratch(spark, "repeats")
    stream = _landed(spark, f"{root}/events", "id bigint, at timestamp, event_type string, amount double")
    seen = None
    for rows in _landings(spark, sf):
        again = rows if seen is None else rows.unionByName(seen.where("id % 3 = 0"))
        seen = rows if seen is None else seen.unionByName(rows)
        again.unionByName(rows.where("id % 2 = 0")).write.mode("append").parquet(f"{root}/events")
        stages.drain(once(stream, ["id"], "at", "40 days"), sinks.table(f"{root}/once"), f"{root}/progress")
    kept = spark.read.schema("id bigint, at timestamp, event_type string, amount double").parquet(f"{root}/once")
    return kept.selectExpr("id", "unix_micros(at) as at_us", "event_type")
