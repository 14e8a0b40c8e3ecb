"""Record layouts and enum codes of the message log."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LOG = _struct(
    key=T.BinaryType(),
    value=T.BinaryType(),
    topic=T.StringType(),
    partition=T.IntegerType(),
    offset=T.LongType(),
    timestamp=T.TimestampType(),
)

TYPED = _struct(type=T.IntegerType())
ADDR = _struct(user=TYPED, channel=TYPED)
DATA = _struct(format=T.IntegerType(), data=T.BinaryType())
PROPERTY = _struct(name=T.StringType(), value=DATA)
SESSION = _struct(type=T.IntegerType(), data=T.ArrayType(PROPERTY))


def _msg(nanos: T.DataType) -> T.StructType:
    return _struct(type=T.IntegerType(), id=T.StringType(), ver=T.LongType(), tsNanos=nanos)


def _msg_req(nanos: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", T.StringType()),
            T.StructField("app", T.StringType()),
            T.StructField("session", SESSION),
            T.StructField("msg", _msg(nanos)),
            T.StructField("from", ADDR),
            T.StructField("to", T.ArrayType(ADDR)),
        ]
    )


MSG_REQ = _msg_req(T.LongType())
REPORT = T.StructType(
    [T.StructField("from", ADDR), T.StructField("to", ADDR), T.StructField("stat", _struct(code=T.IntegerType()))]
)


def _request(nanos: T.DataType) -> T.StructType:
    return _struct(type=T.IntegerType(), tsNanos=nanos, msgReq=_msg_req(nanos))


def _event(nanos: T.DataType) -> T.StructType:
    delivery = _struct(req=_msg_req(nanos), report=T.ArrayType(REPORT))
    return _struct(type=T.IntegerType(), tsNanos=nanos, msgDelivery=delivery)


def _store_event(nanos: T.DataType) -> T.StructType:
    created = _struct(index=T.StringType(), id=T.StringType(), type=T.StringType(), ver=T.LongType())
    return _struct(type=T.IntegerType(), tsNanos=nanos, msgCreated=created)


REQUEST = _request(T.LongType())
EVENT = _event(T.LongType())
STORE_EVENT = _store_event(T.LongType())

# The same records with room for the full unsigned 64-bit range of their nanosecond fields;
# used only to tell an out-of-range time from other damage.
NANOS_WIDE = T.DecimalType(20, 0)
MSG_REQ_WIDE = _msg_req(NANOS_WIDE)
REQUEST_WIDE = _request(NANOS_WIDE)
EVENT_WIDE = _event(NANOS_WIDE)

# Enum codes and names of the record format.
ENUMS: dict[str, dict[int, str]] = {
    "data_format": {0: "RAW", 1: "JSON", 2: "PB"},
    "session_type": {0: "Unknown", 1: "Chat", 2: "Message"},
    "channel_type": {0: "Unknown", 32: "Chat", 33: "Message", 64: "Facebook", 65: "Twitter"},
    "role_type": {0: "Unknonw", 1: "Agent", 2: "Client"},
    "user_type": {0: "Unknown", 32: "Chat", 33: "Message", 64: "Facebook", 65: "Twitter"},
    "msg_type": {0: "Unknown", 1: "Agent", 2: "Client", 128: "BotHandover", 129: "Assign"},
    "delivery_code": {
        0: "Unknown",
        1: "Accepted",
        2: "Sent",
        3: "Confirmed",
        64: "Onhold",
        128: "Failed",
        129: "Aborted",
    },
    "request_type": {0: "Unknown", 1: "MsgReq"},
    "event_type": {0: "Unknown", 10: "MsgDelivery"},
    "store_event_type": {0: "Unknown", 32: "MsgCreated", 33: "MsgUpdated", 34: "MsgDeleted"},
}

# Codes the operators refer to by name.
REQUEST_MSG_REQ = 1
EVENT_MSG_DELIVERY = 10
STORE_MSG_CREATED = 32
STORE_MSG_UPDATED = 33
STORE_MSG_DELETED = 34
DELIVERY_ACCEPTED = 1
DOCUMENT_TYPE = "messages"
