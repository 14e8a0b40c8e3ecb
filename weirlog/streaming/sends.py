"""Sends whose state lasts over batches, and ids handed out over batches.

A message is ``new``, then ``sent``, then ``acked`` or ``failed``, and from there sent again. Changes of state
come in batches in any mixture; the table keeps the latest state of each message with its key and value,
and forgets acknowledged ones when segments are merged. What is sent next is picked from that state.
A batch looks at what batches before it stored, so running it again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.operators.blocks import BLOCK_BITS, number_rows
from weirlog.operators.outbox import SEND_BATCH, drain_head
from weirlog.session import join_lookup, settle
from weirlog.streaming.keyed_table import KeyedTable
from weirlog.streaming.sinks import claim

_ID = [T.StructField("topic", T.StringType()), T.StructField("id", T.LongType())]
SENDS = T.StructType(
    [
        *_ID,
        T.StructField("state", T.StringType()),
        T.StructField("sends", T.IntegerType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("version", T.LongType()),
    ]
)
MARKS = T.StructType([_ID[0], T.StructField("last_id", T.LongType()), T.StructField("version", T.LongType())])


def send_table(root: str) -> KeyedTable:
    return KeyedTable(root, SENDS, ("topic", "id"), "version", done="state = 'acked'")


def high_water_marks(root: str) -> KeyedTable:
    """The last id of each topic."""
    return KeyedTable(root, MARKS, ("topic",), "version", buckets=1)


def allocate_ids(rows: DataFrame, root: str, batch_id: int, arrival: str, bits: int = BLOCK_BITS) -> DataFrame:
    """``rows`` with ``enqueue_id``: ids per topic in arrival order that go on where the batch before ended.

    ``root`` keeps the last id of each topic. Running a batch again gives the same ids.
    """
    claim(rows.sparkSession, root)
    marks = high_water_marks(root)
    rows = settle(rows)
    last = marks.find(rows.select("topic"), before=batch_id).select("topic", "last_id")
    numbered = number_rows(rows, ["topic"], arrival, "enqueue_id", bits=bits)
    ids = join_lookup(numbered, last, ["topic"], "left")
    ids = settle(ids.selectExpr(*[f"`{c}`" for c in rows.columns], "enqueue_id + coalesce(last_id, 0L) as enqueue_id"))
    marks.change(ids.groupBy("topic").agg(F.max("enqueue_id").alias("last_id")).withColumn("version", F.lit(batch_id).cast("long")), batch_id)
    return ids


def apply_changes(changes: DataFrame, root: str, batch_id: int) -> DataFrame:
    """Merge a batch of changes (topic, id, state, at, key, value) into the table; returns the rows that changed.

    ``at`` orders the changes of a message inside the batch. An acknowledgement is final, whatever comes with
    or after it. A change of a message that is neither stored nor new in this batch is an answer that comes late or twice, and
    is left out. Key and value are those the message was new with.
    """
    claim(changes.sparkSession, root)
    table = send_table(root)
    once = settle(changes.groupBy("topic", "id").agg(
        F.expr("if(bool_or(state = 'acked'), 'acked', max_by(state, at)) as state"),
        F.expr("cast(count_if(state = 'sent') as int) as sends"),
        F.expr("bool_or(state = 'new') as is_new"),
        F.expr("any_value(key) filter (where state = 'new') as key"),
        F.expr("any_value(value) filter (where state = 'new') as value"),
    ))
    stored = table.find(once, before=batch_id).selectExpr("topic", "id", *[f"`{c}` as old_{c}" for c in SENDS.names[2:]])
    merged = once.join(stored, ["topic", "id"], "left").where("if(old_version is null, is_new, old_state <> 'acked')")
    merged = merged.where("old_version is null or (state <> 'new' and (state <> old_state or sends > 0))")
    merged = settle(merged.selectExpr(
        "topic",
        "id",
        "state",
        "cast(sends + coalesce(old_sends, 0) as int) as sends",
        "if(old_version is null, key, old_key) as key",
        "if(old_version is null, value, old_value) as value",
        "coalesce(old_version, 0L) + 1 as version",
    ))
    table.change(merged, batch_id)
    return merged


def take(spark: SparkSession, root: str, batch_id: int, count: int = SEND_BATCH) -> DataFrame:
    """The next rows of each topic to send, all failed or all new, which are ``sent`` from this batch on."""
    table = send_table(root)
    before = table.segments(spark, before=batch_id)
    picked = settle(drain_head(table.rows_of(spark, before), count).select("topic", "id", "key", "value", "state", "place"))
    apply_changes(picked.selectExpr("topic", "id", "'sent' as state", "0L as at", "key", "value"), root, batch_id)
    return picked


def restore(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """After a restart nobody waits for the answers to what is ``sent``: such rows are queued again."""
    table = send_table(root)
    waiting = table.rows_of(spark, table.segments(spark, before=batch_id)).where("state = 'sent'")
    return apply_changes(waiting.selectExpr("topic", "id", "'failed' as state", "0L as at", "key", "value"), root, batch_id)
