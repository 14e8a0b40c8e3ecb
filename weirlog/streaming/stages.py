"""The stages of a message store, chained through topics.

``ingress``: landed request bodies -> request topic, and a response to each request.
``accept``: request topic -> delivery events, keyed by sender, on the store topic.
``store``: store topic -> document table, and a change event for each new document.
``changes``: change topic -> table of created documents for readers.

Each is one streaming query; all but the first read rows in log layout, from files or Kafka. A batch that
fails is run again from the checkpoint; what it completed stays as it is, and replayed rows end as ``noop``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weirlog.functions.identity import sender_key
from weirlog.operators.delivery import accept, delivery_events, requests, response, wrap_request
from weirlog.operators.envelope import decode, good, of_type, quarantine
from weirlog.operators.upsert import created_events, document_updates
from weirlog.schemas import STORE_EVENT, STORE_MSG_CREATED
from weirlog.sources.bodies import bad_bodies, parse_bodies, requests_of
from weirlog.streaming.documents import fold_batch, store_documents
from weirlog.streaming.frontier import track_frontier
from weirlog.streaming.sinks import Sink, fan_out, log_rows


def start(stream: DataFrame, sink: Sink, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Run a sink over a stream: every so often, or through all rows present and then stop."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def drain(stream: DataFrame, sink: Sink, checkpoint: str) -> None:
    """Run a sink through all rows present."""
    start(stream, sink, checkpoint).awaitTermination()


def with_progress(stage: Sink, root: str, seeds: DataFrame) -> Sink:
    """A stage over log rows that saves its frontiers: once it is through with a batch, the positions of all its rows
    are confirmed, those set aside included. ``frontier.current_frontier`` reads them from ``root``; ``seeds`` are the
    frontiers before the stream began (see there)."""
    return fan_out(stage, track_frontier(root, seeds))


def ingress_stage(topics: Sink, responses: Sink, aside: Sink, request_topic: str) -> Sink:
    """Takes bodies (see ``sources.bodies``) rather than log rows.

    Landed bodies have no log position. They get one that rises from batch to batch and, within
    a task, in the order of the rows. A broker gives positions of its own.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_bodies(batch).persist()
        try:
            rows = requests_of(parsed).selectExpr(
                f"{sender_key('req.`from`')} as sender",
                f"{wrap_request('req', 'unix_micros(landed) * 1000')} as request",
                "spark_partition_id() as partition",
                f"{batch_id << 33}L + (monotonically_increasing_id() & {(1 << 33) - 1}L) as offset",
                "landed as timestamp",
            )
            topics(log_rows(rows, f"'{request_topic}'", "sender", "request"), batch_id)
            responses(requests_of(parsed).selectExpr("body_id", "place", f"inline(array({response('req')}))"), batch_id)
            aside(bad_bodies(parsed), batch_id)
        finally:
            parsed.unpersist()

    return run


def accept_stage(topics: Sink, aside: Sink, store_topic: str) -> Sink:
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = requests(batch).persist()
        try:
            topics(log_rows(accept(good(rows)), f"'{store_topic}'", "sender", "event"), batch_id)
            aside(quarantine(rows), batch_id)
        finally:
            rows.unpersist()

    return run


def store_stage(topics: Sink, aside: Sink, documents: str, change_topic: str, prefix: str, **limits: int) -> Sink:
    def run(batch: DataFrame, batch_id: int) -> None:
        rows, folded = delivery_events(batch).persist(), None
        try:
            folded = fold_batch(document_updates(good(rows), prefix), documents, batch_id, **limits).persist()
            store_documents(folded, documents, batch_id)
            topics(log_rows(created_events(folded), f"'{change_topic}'", "sender", "event"), batch_id)
            aside(quarantine(rows), batch_id)
        finally:
            if folded is not None:
                folded.unpersist()
            rows.unpersist()

    return run


def created_documents(log: DataFrame) -> DataFrame:
    """Created documents announced on a change topic."""
    return _created(decode(log, STORE_EVENT))


def _created(rows: DataFrame) -> DataFrame:
    return of_type(good(rows), STORE_MSG_CREATED).selectExpr(
        "partition",
        "offset",
        "data.msgCreated.index as index",
        "data.msgCreated.id as doc_id",
        "data.msgCreated.type as type",
        "data.msgCreated.ver as version",
    )


def changes_stage(changes: Sink, aside: Sink) -> Sink:
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = decode(batch, STORE_EVENT).persist()
        try:
            changes(_created(rows), batch_id)
            aside(quarantine(rows), batch_id)
        finally:
            rows.unpersist()

    return run
