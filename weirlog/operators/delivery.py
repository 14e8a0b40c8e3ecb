"""Requests in, responses and delivery events out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weirlog.functions.identity import document_id, sender_key
from weirlog.functions.unions import tagged
from weirlog.operators.envelope import decode
from weirlog.schemas import (
    DELIVERY_ACCEPTED,
    EVENT,
    EVENT_MSG_DELIVERY,
    EVENT_WIDE,
    REQUEST,
    REQUEST_MSG_REQ,
    REQUEST_WIDE,
)

REQUEST_NANOS = ["tsNanos", "msgReq.msg.tsNanos"]
EVENT_NANOS = ["tsNanos", "msgDelivery.req.msg.tsNanos"]


def wrap_request(req: str, nanos: str) -> str:
    """Request envelope. Pass the log time as ``nanos`` so that a replay gives the same bytes."""
    return tagged(REQUEST_MSG_REQ, ("msgReq", req), nanos)


def response(req: str) -> str:
    """Answer to a request; the error fields are never set."""
    return f"""named_struct('id', {req}.id, 'app', {req}.app, 'session', {req}.session,
        'errCode', 0, 'errMsg', '')"""


def accepted_event(req: str) -> str:
    """Delivery event with one report: accepted for the first recipient. Its time stays 0."""
    report = f"""named_struct('from', {req}.`from`, 'to', get({req}.to, 0),
        'stat', named_struct('code', {DELIVERY_ACCEPTED}))"""
    return tagged(EVENT_MSG_DELIVERY, ("msgDelivery", f"named_struct('req', {req}, 'report', array({report}))"), "0")


def requests(log: DataFrame) -> DataFrame:
    """Decoded request rows. Other request types pass, with no event to come and no problem."""
    problem = f"""case when data.type = {REQUEST_MSG_REQ} then
        case when data.msgReq is null then 'payload_missing'
             when data.msgReq.msg.tsNanos < 0 or data.tsNanos < 0 then 'ts_out_of_range'
             when get(data.msgReq.to, 0) is null then 'no_recipient'
             when {document_id('data.msgReq')} is null then 'no_document_id' end end"""
    return decode(log, REQUEST, REQUEST_WIDE, REQUEST_NANOS, problem)


def accept(rows: DataFrame) -> DataFrame:
    """Events for decoded, problem-free request rows, keyed by sender, at their source offsets."""
    return rows.where(f"data.type = {REQUEST_MSG_REQ}").selectExpr(
        "topic",
        "partition",
        "offset",
        "timestamp",
        f"{sender_key('data.msgReq.`from`')} as sender",
        f"{accepted_event('data.msgReq')} as event",
    )


def delivery_events(log: DataFrame) -> DataFrame:
    """Decoded event rows; events that are not deliveries are set aside."""
    problem = f"""case when data.type is null or data.type <> {EVENT_MSG_DELIVERY} then 'unknown_type'
        when data.msgDelivery.req is null then 'payload_missing'
        when data.msgDelivery.req.msg.tsNanos < 0 or data.tsNanos < 0 then 'ts_out_of_range'
        when {document_id('data.msgDelivery.req')} is null then 'no_document_id' end"""
    return decode(log, EVENT, EVENT_WIDE, EVENT_NANOS, problem)
