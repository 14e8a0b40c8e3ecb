"""The driver's tables seen as logs, outboxes, requests and documents (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog.functions.times import micros_of
from weirlog.functions.unions import tagged
from weirlog.operators.blocks import number_rows
from weirlog.operators.delivery import accepted_event, wrap_request
from weirlog.operators.progress import PARTITION, partition_ranges
from weirlog.schemas import STORE_MSG_CREATED, STORE_MSG_DELETED, STORE_MSG_UPDATED
from weirlog.session import use_utc

PARTITIONS = 4
PROPS = T.StructType([T.StructField("k", T.LongType())])

IS_ACK = "event_type <> 'error'"
IS_ERROR = "(event_type = 'error' and amount > 100)"
STATE = """case event_type when 'error' then 'failed' when 'click' then 'sent' when 'purchase' then 'acked'
    else 'new' end"""
DELIVERY_CODE = """case event_type when 'signup' then 1 when 'view' then 2 when 'click' then 3
    when 'purchase' then 64 else if(value > 100, 129, 128) end"""

# Columns of the tables used here. Naming them spares a look into the files of every scan.
_TABLES = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
}


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.schema(_TABLES[name]).parquet(f"{sf}/{name}.parquet")


# --- events as a log ------------------------------------------------------------------------


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    events = source(spark, sf, "events").selectExpr(
        "'events' as topic",
        f"cast(user_id % {PARTITIONS} as int) as partition",
        "event_id",
        "event_type",
        "value as amount",
        "cast(user_id as string) as log_key",
        "props as log_value",
        f"{micros_of('ts')} as ts_us",
    )
    return number_rows(events, PARTITION, "event_id", "offset", start=-1)


def raw_log(rows: DataFrame, topic: str = "topic", value: str = "log_value") -> DataFrame:
    """``event_log`` rows in log layout."""
    return rows.selectExpr(
        "encode(log_key, 'UTF-8') as key",
        f"encode({value}, 'UTF-8') as value",
        f"{topic} as topic",
        "partition",
        "offset",
        "timestamp_micros(ts_us) as timestamp",
    )


def damaged_log(spark: SparkSession, sf: str) -> DataFrame:
    return raw_log(event_log(spark, sf), value="if(event_id % 100 = 0, '{bad', log_value)")


def outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Send queue in arrival order. Ids follow from the event ids, which are dense."""
    return source(spark, sf, "events").selectExpr(
        "event_id + 1 as id", "'events' as topic", f"{STATE} as state", "event_type", "value as amount"
    )


def send_history(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of state of the queue's messages over four batches: a message arrives in one of the first three, and
    clicks, purchases and errors are sent in the next batch. Purchases are acknowledged, errors fail; every
    other error is sent once more, and half of these are acknowledged."""
    b = "event_id % 3"
    changes = ", ".join(
        f"named_struct('state', '{state}', 'batch_id', {batch}, 'at', {at}L, 'holds', {holds})"
        for state, batch, at, holds in (
            ("new", b, 0, "true"),
            ("sent", f"{b} + 1", 1, "event_type in ('click', 'purchase', 'error')"),
            ("acked", f"{b} + 1", 2, "event_type = 'purchase'"),
            ("failed", f"{b} + 1", 2, "event_type = 'error'"),
            ("sent", f"{b} + 2", 3, "event_type = 'error' and event_id % 2 = 0"),
            ("acked", f"{b} + 2", 4, "event_type = 'error' and event_id % 4 = 0"),
        )
    )
    rows = source(spark, sf, "events").selectExpr(
        "'events' as topic", "event_id + 1 as id", "encode(cast(user_id as string), 'UTF-8') as key", "encode(props, 'UTF-8') as value",
        f"inline(filter(array({changes}), c -> c.holds and c.batch_id < 4))",
    )
    return rows.selectExpr("topic", "id", "state", "cast(batch_id as int) as batch_id", "at", "if(state = 'new', key, null) as key", "if(state = 'new', value, null) as value")


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages not yet numbered."""
    return source(spark, sf, "events").selectExpr("event_id", "'events' as topic", f"{micros_of('ts')} as ts_us")


def saved_offsets(log: DataFrame, name: str = "saved") -> DataFrame:
    at = "case partition when 0 then -1L when 1 then 0L when 2 then 100L else newest end"
    return partition_ranges(log).selectExpr(*PARTITION, f"{at} as {name}")


def document_log(spark: SparkSession, sf: str) -> DataFrame:
    """Updates of one document per user; nulls stand for fields not given."""
    return source(spark, sf, "events").selectExpr(
        "user_id",
        "event_id",
        "event_type",
        "value as amount",
        "nullif(event_type, 'view') as f_status",
        "if(value >= 10, cast(floor(value / 50) as int), null) as f_tier",
    )


# --- conversations as requests --------------------------------------------------------------

_ADDRESSES = "array<struct<user:struct<type:int>,channel:struct<type:int>>>"


def _address(number: str) -> str:
    code = f"named_struct('type', element_at(array(32, 33, 64, 65), cast({number} % 4 as int) + 1))"
    return f"named_struct('user', {code}, 'channel', {code})"


def messages(spark: SparkSession, sf: str, ver: str = "1") -> DataFrame:
    """``conv_id, turn, role, ts_nanos, req``: one request per turn, holding its whole text."""
    turns = source(spark, sf, "conversations").selectExpr(
        "*",
        "(1704067200 + conv_id * 86400 + turn * 60) * 1000000000 as ts_nanos",
        "concat(conv_id, '-', turn) as name",
        "case role when 'user' then 2 when 'assistant' then 1 else 128 end as kind",
    )
    text = "named_struct('name', 'text', 'value', named_struct('format', 0, 'data', encode(text, 'UTF-8')))"
    req = f"""named_struct(
        'id', name,
        'app', 'conv',
        'session', named_struct('type', cast(conv_id % 2 as int) + 1, 'data', array({text})),
        'msg', named_struct('type', kind, 'id', name, 'ver', cast({ver} as bigint), 'tsNanos', ts_nanos),
        'from', {_address('conv_id')},
        'to', if(role = 'system', cast(array() as {_ADDRESSES}), array({_address('(conv_id + 1)')})))"""
    return turns.selectExpr("conv_id", "turn", "role", "ts_nanos", f"{req} as req")


def _placed(rows: DataFrame, topic: str, value: str, step: int = 0) -> DataFrame:
    """Rows in log layout. Offsets rise with conversation and turn and leave gaps."""
    return rows.selectExpr(
        "encode(concat(req.`from`.user.type, ':', req.`from`.channel.type), 'UTF-8') as key",
        f"encode({value}, 'UTF-8') as value",
        f"'{topic}' as topic",
        f"cast(conv_id % {PARTITIONS} as int) as partition",
        f"conv_id div {PARTITIONS} * 1048576 + {step * 524288} + turn as offset",
        f"timestamp_micros(ts_nanos div 1000 + {step * 1_000_000}) as timestamp",
    )


def first_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a request, some of them damaged, of another type, or missing."""
    text = f"to_json({wrap_request('req', 'ts_nanos')})"
    value = f"""case when (conv_id + turn) % 13 = 12 then null
        when (conv_id + turn) % 11 = 5 then '{{bad'
        when (conv_id + turn) % 11 = 1 then concat({text}, 'and more')
        when (conv_id + turn) % 11 = 2 then concat({text}, {text})
        when (conv_id + turn) % 11 = 3 then concat('\n\t', {text}, ' \r\n')
        when (conv_id + turn) % 11 = 7 then to_json({tagged(0, ('msgReq', 'req'), 'ts_nanos')})
        when (conv_id + turn) % 11 = 9 then replace({text}, cast(ts_nanos as string), '18446744073709551615')
        else {text} end"""
    return _placed(messages(spark, sf), "requests", value)


def repeated_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A second delivery of every turn, the users' turns with a new version."""
    rows = messages(spark, sf, "if(role = 'user', 2, 1)")
    return _placed(rows, "requests", f"to_json({wrap_request('req', 'ts_nanos')})", step=1)


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    return first_requests(spark, sf).unionByName(repeated_requests(spark, sf))


def delivery_log(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as delivery events; every fifth turn of a conversation has another type."""
    event = accepted_event("req")
    other = tagged(0, ("msgDelivery", f"{event}.msgDelivery"), "0")
    return _placed(messages(spark, sf), "deliveries", f"if(turn % 5 = 4, to_json({other}), to_json({event}))")


def change_log(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as change events: user turns created, assistant turns updated, the rest deleted."""
    created = """named_struct('index', concat('docs_', role), 'id', req.id, 'type', 'messages', 'ver', req.msg.ver)"""
    value = f"""case role when 'user' then to_json({tagged(STORE_MSG_CREATED, ('msgCreated', created))})
        when 'assistant' then to_json({tagged(STORE_MSG_UPDATED)}) else to_json({tagged(STORE_MSG_DELETED)}) end"""
    return _placed(messages(spark, sf), "changes", value)


def tagged_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests whose tag or payload is wrong in places: ``id, type, req``."""
    return messages(spark, sf).selectExpr(
        "req.id", "if(turn % 5 = 4, 0, 1) as type", "if(turn % 7 <> 6, req, null) as req"
    )


BODY_TURNS = 64


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as landed JSON arrays of at most 64 requests; some are damaged."""
    rows = messages(spark, sf).selectExpr(
        "conv_id", f"turn div {BODY_TURNS} as chunk", "struct(turn, to_json(req) as text) as item"
    )
    arrays = rows.groupBy("conv_id", "chunk").agg(
        F.expr("array_join(transform(array_sort(collect_list(item)), i -> i.text), ',') as text")
    )
    return arrays.selectExpr(
        "concat(conv_id, '/', chunk) as body_id",
        """case conv_id % 10 when 3 then concat('[', text)
           when 6 then concat('[', text, ',{"id":"7","msg":"oops"}]') else concat('[', text, ']') end as value""",
    )
